"""Run logs over the events table: a user's events of a day are a run, purchases are errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.plans import runs
from colophon.queries import query, read, stated

_T = "epoch_us(ts) / 1000000.0"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events")
    return df.select(F.col("user_id").alias("run"), F.col("event_id").alias("item"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("t"), (F.col("event_type") != "purchase").alias("ok"), F.col("value").alias("seconds"), (F.col("event_id") % 50).alias("book"), F.col("event_type"))


@query("""SELECT user_id run, count(*) calls, count(*) FILTER (WHERE event_type <> 'purchase') ok, round(sum(value), 4) AS seconds, count(DISTINCT event_id % 50) books FROM events GROUP BY user_id""")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG14."""
    return runs.run_totals(_events(spark, sf_dir)).withColumn("seconds", F.round("seconds", 4))


@query(f"""SELECT run, item, done, round(CASE WHEN t - t0 >= 20 AND done >= 3 THEN (1000 - done) * (t - t0) / done END, 3) AS left FROM
    (SELECT user_id run, event_id item, {_T} t, min({_T}) OVER (PARTITION BY user_id) t0, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) done FROM events)""")
def eta_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN7."""
    return runs.eta(_events(spark, sf_dir).withColumn("total", F.lit(1000))).select("run", "item", "done", F.round("left", 3).alias("left"))


@query("""SELECT run, max(n) longest FROM (SELECT run, g, count(*) n FROM (SELECT user_id run, event_type, sum(CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) g FROM events) WHERE event_type = 'purchase' GROUP BY run, g) GROUP BY run""")
def error_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQ5."""
    return runs.error_streaks(_events(spark, sf_dir), order=("t", "item"))


@query(f"""SELECT run, round(max(t) - min(t) - coalesce(sum(CASE WHEN event_type = 'error' THEN coalesce(nxt, t) - t END), 0), 3) active FROM (SELECT user_id run, event_type, {_T} t, lead({_T}) OVER (PARTITION BY user_id ORDER BY ts) nxt FROM events) GROUP BY run""")
def active_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN8, with error events as pauses."""
    df = _events(spark, sf_dir).withColumn("kind", F.when(F.col("event_type") == "error", "pause").otherwise("go"))
    return runs.active_seconds(df).withColumn("active", F.round("active", 3))


@stated("""SELECT 20000 AS len, 0.5::DOUBLE AS ratio, 9000 AS next UNION ALL SELECT 20000, NULL, 9000 UNION ALL SELECT 600, 0.99::DOUBLE, 500 UNION ALL SELECT 500, 0.5::DOUBLE, NULL""")
def shorter_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQ6."""
    df = spark.createDataFrame([(20000, 0.5), (20000, None), (600, 0.99), (500, 0.5)], "len int, ratio double")
    return df.select("len", "ratio", runs.shorter(F.col("len"), F.col("ratio")).alias("next"))
