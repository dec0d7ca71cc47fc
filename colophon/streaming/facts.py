"""Incremental facts: each batch of changed records refreshes only what is out of date.

Facts live in a Parquet log per kind: numbered folders, each with the fresh facts of one batch. The latest fact of a
record counts. After COMPACT batches the log is rewritten as one folder, marked as a base, and what stands before it goes,
so that a batch writes what it changed and no more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colophon.plans.selection import fact_delta


def merged(facts: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """SK7: the latest fact of each record; fresh ones win."""
    if facts is None:
        return fresh
    both = facts.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    last = Window.partitionBy("lib", "id").orderBy(F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "_new")


def forget_unseen(facts: DataFrame, books: DataFrame) -> DataFrame:
    """SK6: facts of records that still exist."""
    return facts.join(books.select("lib", "id").distinct(), ["lib", "id"], "left_semi")


def newest(spark: SparkSession, folder: str) -> tuple[int, DataFrame | None]:
    """The number and the frame of the newest complete version of a table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return -1, None
    numbers = [int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return (max(numbers), spark.read.parquet(f"{folder}/{max(numbers)}")) if numbers else (-1, None)


#: Batches after which a log is rewritten.
COMPACT = 16
_BASE = "_BASE"


def _log(spark: SparkSession, folder: str) -> tuple[list[int], object]:
    """Numbers of the complete folders from the newest base on, and the file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    root = path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return [], fs
    done = sorted(int(s.getPath().getName()) for s in fs.listStatus(root) if s.getPath().getName().isdigit() and fs.exists(path(s.getPath(), "_SUCCESS")))
    bases = [n for n in done if fs.exists(path(f"{folder}/{n}/{_BASE}"))]
    return [n for n in done if n >= max(bases, default=0)], fs


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """The latest fact of each record, or None without any."""
    numbers, _ = _log(spark, folder)
    if not numbers:
        return None
    parts = [spark.read.parquet(f"{folder}/{n}").withColumn("_part", F.lit(n)) for n in numbers]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    if len(parts) == 1:
        return both.drop("_part")
    columns = [c for c in both.columns if c not in ("lib", "id", "_part")]
    latest = both.groupBy("lib", "id").agg(F.max_by(F.struct(*columns), "_part").alias("f"))
    return latest.select("lib", "id", "f.*")


def compact(spark: SparkSession, folder: str) -> None:
    """Rewrites the log as one base; older folders go once it is complete."""
    numbers, fs = _log(spark, folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    number = numbers[-1] + 1
    current(spark, folder).write.mode("overwrite").parquet(f"{folder}/{number}")
    fs.create(path(f"{folder}/{number}/{_BASE}")).close()
    for n in numbers:
        fs.delete(path(f"{folder}/{n}"), True)


def refresh(changed: DataFrame, folder: str, compute: Callable[[DataFrame], DataFrame]) -> int:
    """Adds one batch's fresh facts to the log; returns how many records were computed anew."""
    spark = changed.sparkSession
    numbers, _ = _log(spark, folder)
    facts = current(spark, folder)
    todo = changed if facts is None else fact_delta(changed, facts)
    number = numbers[-1] + 1 if numbers else 0
    compute(todo).write.mode("overwrite").parquet(f"{folder}/{number}")
    n = spark.read.parquet(f"{folder}/{number}").count()
    if len(numbers) + 1 >= COMPACT:
        compact(spark, folder)
    return n


def stream_facts(changes: DataFrame, folder: str, checkpoint: str, compute: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """A streaming query that keeps the facts of a stream of changed records fresh."""
    return changes.writeStream.foreachBatch(lambda batch, _: refresh(batch, folder, compute)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
