"""Which records differ between two states, by hash trees over ranges of ids (AG13, SL9).

A state is saved as its records, dealt into folders by ranges of ids, and a tree of hashes: a leaf covers LEAF ids, a node FANOUT nodes of the level
below, and each has the number of its records and two order-free hashes of (id, version). Two states are compared from the top:
only children of nodes that differ are looked at, and at last only the records of leaves that differ are read. Equal states differ nowhere, so
one row of each is read; a change reads one branch, however large the library is.

The two hashes are a sum and an exclusive or of 64 bits over differently seeded row hashes.

Cases: a null version is a version; rows with a null id or library aren't records of a state; ids may be negative; a repeated id counts as
often as it stands; a library that one state lacks differs as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.operators.tables import bounded, written

#: Ids of a leaf, and children of a node.
LEAF, FANOUT = 256, 16
#: Nodes that differ up to which they are broadcast.
SMALL = 200_000
_SAME = ["n", "total", "mixed"]


def _node(level: int):
    """The node of an id on a level; leaves are level 0."""
    return F.floor(F.col("id") / F.lit(LEAF * FANOUT**level)).cast("bigint")


def tree(records: DataFrame) -> DataFrame:
    """(level, lib, node, n, total, mixed) of ``records(lib, id, version)``; the top level has a node for each library."""
    own = F.struct("id", "version")
    rows = records.filter("lib is not null and id is not null").select("lib", "id", F.xxhash64(own, F.lit(1)).alias("h"), F.xxhash64(own, F.lit(2)).alias("g"))
    # sums may pass 64 bits: they are taken modulo 2**64 by halves
    low, high = F.sum(F.col("h").bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftrightunsigned("h", 32))
    level = rows.withColumn("node", _node(0)).groupBy("lib", "node").agg(F.count("*").alias("n"), low.alias("low"), high.alias("high"), F.bit_xor("g").alias("mixed"))
    spread = level.agg(F.max(F.abs("node"))).first()[0] or 0
    level = written(level, "leaves")
    out, k = level.withColumn("level", F.lit(0)), 0
    while spread > 0:
        k, spread = k + 1, spread // FANOUT
        level = level.withColumn("node", F.floor(F.col("node") / FANOUT).cast("bigint")).groupBy("lib", "node").agg(F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum("high").alias("high"), F.bit_xor("mixed").alias("mixed"))
        out = out.union(level.withColumn("level", F.lit(k)))
    # negative and other ids meet above all levels
    top = level.groupBy("lib").agg(F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum("high").alias("high"), F.bit_xor("mixed").alias("mixed"))
    out = out.unionByName(top.select("lib", F.lit(0).cast("bigint").alias("node"), "n", "low", "high", "mixed", F.lit(k + 1).alias("level")))
    return out.select("level", "lib", "node", "n", F.struct("high", "low").alias("total"), "mixed")


def save(records: DataFrame, folder: str) -> None:
    """Saves a state of ``records(lib, id, version)``."""
    rows = records.filter("lib is not null and id is not null").select("lib", "id", "version", _node(1).alias("part"), _node(0).alias("leaf"))
    rows.repartition("lib", "part").sortWithinPartitions("lib", "part", "leaf").write.partitionBy("part").parquet(f"{folder}/records")
    tree(saved(records.sparkSession, folder).select("lib", "id", "version")).write.partitionBy("level").parquet(f"{folder}/tree")


def saved(spark: SparkSession, folder: str) -> DataFrame:
    """The records of a saved state."""
    return spark.read.schema("lib string, id bigint, version bigint, leaf bigint, part bigint").parquet(f"{folder}/records")


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    kind = "lib string, node bigint, n bigint, total struct<high:bigint,low:bigint>, mixed bigint, level int"
    return spark.read.schema(kind).parquet(f"{folder}/tree")


def roots(spark: SparkSession, folder: str) -> DataFrame:
    """AG13: (lib, n, state) of a saved state: number of records and a hash of all."""
    nodes = _nodes(spark, folder)
    top = nodes.groupBy("lib").agg(F.max_by(F.struct("n", "total", "mixed"), "level").alias("r"))
    return top.select("lib", "r.n", F.xxhash64("r.total", "r.mixed").alias("state"))


def differing_leaves(spark: SparkSession, old: str, new: str) -> DataFrame:
    """(lib, leaf) whose records aren't the same, by descending from the roots."""
    a, b = _nodes(spark, old), _nodes(spark, new)
    tops = [x.agg(F.max("level")).first()[0] or 0 for x in (a, b)]
    level = max(tops)
    # a smaller tree has no nodes above its top: below it both are compared
    unequal: DataFrame | None = None
    for k in range(min(tops) - 1, -1, -1):
        x, y = (n.filter(F.col("level") == k).select("lib", "node", F.struct(*_SAME).alias(name)) for n, name in ((a, "x"), (b, "y")))
        if unequal is not None:
            above = bounded(unequal, SMALL)
            x, y = (n.join(above.withColumnRenamed("node", "up"), (n.lib == above.lib) & (F.floor(n.node / FANOUT) == F.col("up")), "left_semi") for n in (x, y))
        met = x.join(y, ["lib", "node"], "full").filter(~F.col("x").eqNullSafe(F.col("y")))
        unequal = written(met.select("lib", "node"), f"unequal-{level}")
    if unequal is None:
        unequal = written(a.filter("level = 0").select("lib", "node").union(b.filter("level = 0").select("lib", "node")).distinct(), "unequal")
    return unequal.select("lib", F.col("node").alias("leaf"))


def to_read(spark: SparkSession, old: str, new: str) -> int:
    """How many records of both states ``changed`` reads: those of the leaves that differ."""
    leaves = differing_leaves(spark, old, new).withColumnRenamed("leaf", "node")
    nodes = _nodes(spark, old).union(_nodes(spark, new)).filter("level = 0")
    return nodes.join(bounded(leaves, SMALL), ["lib", "node"], "left_semi").agg(F.sum("n")).first()[0] or 0


def changed(spark: SparkSession, old: str, new: str) -> DataFrame:
    """SL9: (lib, id, change) of records added, removed or changed between two saved states."""
    leaves = differing_leaves(spark, old, new).withColumn("part", F.floor(F.col("leaf") / FANOUT).cast("bigint"))
    leaves = bounded(leaves, SMALL)

    def side(folder: str, name: str) -> DataFrame:
        rows = saved(spark, folder).withColumn("side", F.lit(name))
        return rows.join(leaves, ["lib", "part", "leaf"], "left_semi")

    both = side(old, "old").unionByName(side(new, "new"))
    versions = lambda name: F.sort_array(F.collect_list(F.when(F.col("side") == name, F.struct("version"))))
    each = both.groupBy("lib", "id").agg(versions("old").alias("old"), versions("new").alias("new")).filter("old <> new")
    change = F.when(F.size("old") == 0, "added").when(F.size("new") == 0, "removed").otherwise("changed")
    return each.select("lib", "id", change.alias("change"))
