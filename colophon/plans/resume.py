"""Plans in parts: a decision job dealt into ranges of ranks, with a manifest of the complete ones (SQ3, SO5).

A record is only compared with better-ranked ones, so the decisions of the first ranges are final whatever follows: a run that stops after any
range leaves a valid partial plan, and going on takes up the next one. A folder holds

- ``features`` and ``pairs`` (dealt by range), written once when the run starts; where a library has many records to a work, ``classes`` and ``members`` (dealt by
  range) instead of most pairs, as ``ladder.alike`` gives them,
- ``decided/range=k``, the decisions of a range,
- ``manifest/range=k``, a row for each complete range, written last: a range without one is decided again.

A range sees the decisions of earlier ranges as settled and decides its own records in parallel rounds. Its entry counts the pairs of its records, and those of
their classes. Only the manifest, a row for each range, and the cuts reach the driver.

Cases: a range without pairs is complete at once; a run that is already complete stays as it is; cuts may leave ranges empty.
"""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colophon.operators.tables import exchanged
from colophon.plans import ladder
from colophon.plans.rounds import DECIDED, decided, decided_alike

_MADE = "lib string, id bigint, action string, match bigint, why string, notes array<string>, review string, override boolean"
_ENTRY = "pairs bigint, decided bigint, seconds double"
_NO_ID = 1 << 62


def even_cuts(feats: DataFrame, ranges: int) -> list[list[int]]:
    """Last ranks of all ranges but the last, about equally many source records in each.

    Records are counted by format rank and richness, of which there are few, and each such class is cut by quantiles of its ids.
    """
    if ranges < 2:
        return []
    source = feats.filter("side = 'source' and chosen")
    parts = [k / ranges for k in range(1, ranges)]
    classes = source.groupBy("rank", "richness").agg(F.count("*").alias("n"), F.percentile_approx("book", parts, 10_000).alias("ids")).orderBy("rank", F.desc("richness")).collect()
    share, held, cuts = sum(r.n for r in classes) / ranges, 0.0, []
    for r in classes:
        for i in [*r.ids, _NO_ID]:
            held += r.n / ranges
            if len(cuts) < ranges - 1 and held >= share * (len(cuts) + 1):
                cuts.append([1, r["rank"], -r.richness, i])
    return cuts


def _range(order: Column, cuts: Sequence[Sequence[int]]) -> Column:
    """How many cuts a rank is beyond."""
    each = F.array(*(F.array(*(F.lit(x).cast("bigint") for x in c)) for c in cuts)) if cuts else F.array().cast("array<array<bigint>>")
    return F.size(F.filter(each, lambda c: c < order))


def start(books: DataFrame, folder: str, options: ladder.Options, ranges: int | Sequence[Sequence[int]], **facts: object) -> None:
    """Writes what a run needs: features, pairs by range, and the cuts (given, or even ones for so many ranges)."""
    feats, found, classes, members = ladder.compared(books, options, **facts)
    cuts = even_cuts(feats, ranges) if isinstance(ranges, int) else [list(c) for c in ranges]
    feats.withColumn("range", _range(F.col("ord"), cuts)).write.parquet(f"{folder}/features")
    dealt = found.withColumn("range", _range(F.col("own"), cuts))
    dealt.write.partitionBy("range").parquet(f"{folder}/pairs")
    if classes is not None:
        classes.write.parquet(f"{folder}/classes")
        members = members.withColumn("range", _range(F.col("ord"), cuts))
        members.write.partitionBy("range").parquet(f"{folder}/members")
    kinds = [None if df is None else df.schema.json() for df in (dealt, classes, members)]
    books.sparkSession.createDataFrame([(json.dumps(asdict(options)), len(cuts) + 1, *kinds)], "options string, ranges int, pairs string, classes string, members string").coalesce(1).write.parquet(f"{folder}/run")


def _run(spark: SparkSession, folder: str) -> tuple[ladder.Options, int]:
    run = spark.read.parquet(f"{folder}/run").first()
    return ladder.Options(**json.loads(run.options)), run.ranges


def _entries(spark: SparkSession, folder: str) -> list[int]:
    """The ranges that the manifest says are complete."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    root = path(f"{folder}/manifest")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath() for s in fs.listStatus(root)]
    return sorted(int(p.getName().partition("=")[2]) for p in names if p.getName().startswith("range=") and fs.exists(path(p, "_SUCCESS")))


def _made(spark: SparkSession, folder: str, ranges: Sequence[int]) -> DataFrame:
    if not ranges:
        return spark.createDataFrame([], _MADE)
    return spark.read.schema(_MADE).parquet(*(f"{folder}/decided/range={k}" for k in ranges))


def _read(spark: SparkSession, folder: str, what: str) -> DataFrame | None:
    """One of the run's tables; files of a run without any pairs have no rows to read a schema from."""
    kind = spark.read.parquet(f"{folder}/run").first()[what]
    return None if kind is None else spark.read.schema(T.StructType.fromJson(json.loads(kind))).parquet(f"{folder}/{what}")


def _members(spark: SparkSession, folder: str, k: int) -> DataFrame:
    """The records as range ``k`` takes them: its own are to be decided, earlier ones have been, and later ones are nobody's candidates."""
    members = _read(spark, folder, "members")
    return members.filter(~F.col("own") | (F.col("range") <= k)).withColumn("own", F.col("own") & (F.col("range") == k)).drop("range")


def go_on(spark: SparkSession, folder: str, at_most: int | None = None) -> int:
    """Decides the next ranges, ``at_most`` so many; gives how many are left."""
    options, ranges = _run(spark, folder)
    unmatched = ladder.unmatched(options)
    complete = _entries(spark, folder)
    todo = [k for k in range(ranges) if k not in complete]
    for k in todo[:at_most]:
        began = time.time()
        pairs = _read(spark, folder, "pairs").filter(F.col("range") == k).drop("range")
        n, before = pairs.count(), _made(spark, folder, [x for x in complete if x < k])
        classes = _read(spark, folder, "classes")
        if classes is not None:
            members = _members(spark, folder, k)
            n += classes.join(members.filter("own").select("lib", F.col("class").alias("id")).distinct(), ["lib", "id"], "left_semi").count()
        if not n:
            made = spark.createDataFrame([], _MADE)
        elif classes is None:
            made = decided(pairs, unmatched, before)
        else:
            gone = before.filter("action = 'trash'").select("lib", "id")
            left = exchanged(pairs).join(gone.withColumnRenamed("id", "cand"), ["lib", "cand"], "left_anti").select(*pairs.columns)
            made = decided_alike(left, exchanged(classes), exchanged(members).join(gone, ["lib", "id"], "left_anti"), unmatched)
        made.select(*DECIDED).write.mode("overwrite").parquet(f"{folder}/decided/range={k}")
        rows = spark.read.schema(_MADE).parquet(f"{folder}/decided/range={k}").count()
        spark.createDataFrame([(n, rows, time.time() - began)], _ENTRY).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/range={k}")
        complete = sorted([*complete, k])
    return len(todo) - len(todo[:at_most])


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(range, pairs, decided, seconds) of every complete range."""
    complete = _entries(spark, folder)
    if not complete:
        return spark.createDataFrame([], "range int, " + _ENTRY)
    paths = [f"{folder}/manifest/range={k}" for k in complete]
    return spark.read.option("basePath", f"{folder}/manifest").schema(_ENTRY + ", range int").parquet(*paths).select("range", "pairs", "decided", "seconds")


def result(spark: SparkSession, folder: str) -> tuple[DataFrame, bool]:
    """The plan of the complete ranges up to the first that isn't, and whether that is all of it."""
    (options, ranges), complete = _run(spark, folder), _entries(spark, folder)
    upto = next(k for k in range(ranges + 1) if k not in complete)
    feats = spark.read.parquet(f"{folder}/features")
    return ladder.finished(feats, _made(spark, folder, range(upto)), options, F.col("range") < upto), upto == ranges
