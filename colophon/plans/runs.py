"""Run logs: totals, rates and remaining time, streaks of errors, active time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_totals(calls: DataFrame, run: str = "run") -> DataFrame:
    """AG14: per run: calls, ok, seconds and different books of ``calls(run, ok, seconds, book)``."""
    return calls.groupBy(run).agg(F.count("*").alias("calls"), F.count_if("ok").alias("ok"), F.sum("seconds").alias("seconds"), F.countDistinct("book").alias("books"))


def eta(progress: DataFrame, run: str = "run") -> DataFrame:
    """WN7: seconds left by the average rate so far; null before 20 s or three items.

    ``progress(run, t, total)`` has one row for each item done, t in seconds.
    """
    w = Window.partitionBy(run).orderBy("t", "item")
    done = F.row_number().over(w)
    elapsed = F.col("t") - F.min("t").over(Window.partitionBy(run))
    df = progress.withColumn("done", done).withColumn("elapsed", elapsed)
    return df.withColumn("left", F.when((F.col("elapsed") >= 20) & (F.col("done") >= 3), (F.col("total") - F.col("done")) * F.col("elapsed") / F.col("done")))


def error_streaks(calls: DataFrame, run: str = "run", order: tuple[str, ...] = ("t",)) -> DataFrame:
    """SQ5: per run, the longest row of errors; gaps and islands."""
    w = Window.partitionBy(run).orderBy(*order)
    df = calls.withColumn("_good", F.sum(F.col("ok").cast("int")).over(w))
    streaks = df.filter("not ok").groupBy(run, "_good").agg(F.count("*").alias("n"))
    return streaks.groupBy(run).agg(F.max("n").alias("longest"))


def active_seconds(events: DataFrame, run: str = "run") -> DataFrame:
    """WN8: from start to end without the time between a pause and the next event that resumes."""
    w = Window.partitionBy(run).orderBy("t")
    df = events.withColumn("_next", F.lead("t").over(w))
    paused = F.coalesce(F.sum(F.when(F.col("kind") == "pause", F.coalesce("_next", "t") - F.col("t"))), F.lit(0))
    return df.groupBy(run).agg((F.max("t") - F.min("t") - paused).alias("active"))


def shorter(length: Column, ratio: Column) -> Column:
    """SQ6: the next length to try after a request was too long; null where it should give up."""
    cut = F.greatest(F.lit(500), F.floor(length * F.least(F.coalesce(ratio, F.lit(0.5)), F.lit(0.9)) * 0.9).cast("int"))
    return F.when(length > 500, cut)
