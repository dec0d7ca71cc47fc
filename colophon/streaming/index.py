"""A streaming candidate index: keyed state holds the candidates of each block and gives what changes of it.

A block is what may be compared: records of one library with equal title and author keys (JN1). Within a block, records of one class (year
and publisher, both known) are copies of the best-ranked one; the others only raise doubts or differ (DL7). All of that
rests on the best-ranked record of each class, so the state keeps, besides the candidates, the best of each class, and a batch
emits the classes whose best has changed: one row however many copies a class has. ``decisions`` joins them to the records.

A record that comes again replaces its earlier form, one that is ``gone`` leaves; only if it was the best of its class are the
block's candidates read again. Later forms win by ``version``, whatever the order of arrival.

Cases: null years and publishers are classes of their own, without copies; a record that comes twice in one version counts once; rows without an
id are ignored; a replayed batch overwrites its own part of the log.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: What comes in; ``rank`` and ``poor`` (less rich is more) order the records before their ids.
CHANGES = "lib string, block string, id bigint, rank int, poor int, year int, publisher string, version bigint, gone boolean"
#: What goes out: the best of a class, null where the class has become empty.
CLASSES = "lib string, block string, year int, publisher string, rank int, poor int, id bigint"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _class(year: int | None, publisher: str | None) -> tuple[str, str]:
    return "" if year is None else str(year), "" if publisher is None else "=" + publisher


class CandidateIndex(StatefulProcessor):
    """Keeps one block."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "id bigint", "rank int, poor int, year string, publisher string, version bigint, gone boolean")
        self.best = handle.getMapState("best", "year string, publisher string", "rank int, poor int, id bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        latest: dict[int, Row] = {}
        for r in rows:
            if r.id is not None and (r.id not in latest or latest[r.id].version <= r.version):
                latest[r.id] = r
        before: dict[tuple, tuple | None] = {}
        now: dict[tuple, tuple | None] = {}
        lost = set()

        def best(of: tuple) -> tuple | None:
            if of not in before:
                before[of] = now[of] = tuple(self.best.getValue(of)) if self.best.containsKey(of) else None
            return now[of]

        for i, r in sorted(latest.items()):
            old = tuple(self.held.getValue((i,))) if self.held.containsKey((i,)) else None
            if old and old[4] > r.version:
                continue
            of, place = _class(r.year, r.publisher), (r.rank, r.poor, i)
            if old and not old[5]:
                was = best(old[2:4])
                if was and was[2] == i and (r.gone or of != old[2:4] or place > was):
                    lost.add(old[2:4])
            self.held.updateValue((i,), (r.rank, r.poor, *of, r.version, bool(r.gone)))
            if not r.gone and of not in lost and (best(of) is None or place < best(of) or best(of)[2] == i):
                now[of] = place
        if lost:
            # the best of these classes went: the next one is among the candidates held
            for of in lost:
                now[of] = None
            for (i,), (rank, poor, year, publisher, _, gone) in self.held.iterator():
                of = (year, publisher)
                if not gone and of in lost and (now[of] is None or (rank, poor, i) < now[of]):
                    now[of] = (rank, poor, i)
        for of, place in now.items():
            if place == before[of]:
                continue
            if place is None:
                self.best.removeKey(of)
            else:
                self.best.updateValue(of, place)
            year, publisher = (int(of[0]) if of[0] else None), (of[1][1:] if of[1] else None)
            yield Row(lib=key[0], block=key[1], year=year, publisher=publisher, rank=place and place[0], poor=place and place[1], id=place and place[2])

    def close(self) -> None:
        pass


def changed_classes(changes: DataFrame) -> DataFrame:
    """CLASSES whose best changes with each batch of the stream ``changes(CHANGES)``."""
    return changes.groupBy("lib", "block").transformWithState(CandidateIndex(), CLASSES, "Update", "None")


def keep_index(changes: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """A streaming query that appends what changes of the index to a log in ``folder``, a part for each batch."""
    spark = changes.sparkSession
    given = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        add = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/batch={n}")
        return changed_classes(changes).writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, given)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """CLASSES as they stand after all batches of the log."""
    log = spark.read.schema(CLASSES + ", batch int").parquet(folder)
    last = log.groupBy("lib", "block", "year", "publisher").agg(F.max_by(F.struct("rank", "poor", "id"), "batch").alias("b"))
    return last.filter("b.id is not null").select("lib", "block", "year", "publisher", "b.rank", "b.poor", "b.id")


def decisions(records: DataFrame, classes: DataFrame) -> DataFrame:
    """(lib, id, action, match, why) of each of ``records(lib, block, id, rank, poor, year, publisher)``, from the index alone; one library."""
    place = F.struct("rank", "poor", "id")
    keys = ["year", "publisher"]
    # the best of each class, year, publisher and block
    rolled = classes.groupingSets([["lib", "block", *keys], ["lib", "block", "year"], ["lib", "block", "publisher"], ["lib", "block"]], "lib", "block", *keys).agg(F.min(place).alias("b"), F.grouping("year").alias("no_year"), F.grouping("publisher").alias("no_publisher")).select("lib", "block", *keys, "no_year", "no_publisher", "b")
    own = records.select("lib", "block", "id", "rank", "poor", *keys).withColumn("own", place)

    def add(df: DataFrame, name: str, year: object, publisher: object) -> DataFrame:
        """The best of what has this year and publisher; None for any, "null" for none given."""
        levels = rolled.filter((F.col("no_year") == int(year is None)) & (F.col("no_publisher") == int(publisher is None)))
        found = levels.select(F.col("lib").alias("_lib"), F.col("block").alias("_block"), F.col("year").alias("_year"), F.col("publisher").alias("_publisher"), F.col("b").alias(name))
        on = (F.col("lib") == F.col("_lib")) & (F.col("block") == F.col("_block"))
        for c, value in (("year", year), ("publisher", publisher)):
            if value == "null":
                found = found.filter(F.col(f"_{c}").isNull())
            elif value == "own":
                on &= F.col(c).eqNullSafe(F.col(f"_{c}"))
        return df.join(found, on, "left").drop("_lib", "_block", "_year", "_publisher")

    df = own
    for name, year, publisher in (("copy", "own", "own"), ("y0", "own", "null"), ("p0", "null", "own"), ("n0", "null", "null"), ("y1", "own", None), ("n1", "null", None), ("p1", None, "own"), ("m1", None, "null"), ("all", None, None)):
        df = add(df, name, year, publisher)
    no_year, no_publisher = F.col("year").isNull(), F.col("publisher").isNull()
    doubtful = (
        F.when(no_year & no_publisher, F.col("all"))
        .when(no_year, F.least("p1", "m1"))
        .when(no_publisher, F.least("y1", "n1"))
        .otherwise(F.least("y0", "p0", "n0"))
    )
    better = lambda c: F.coalesce(c < F.col("own"), F.lit(False))
    copied = ~no_year & ~no_publisher & better(F.col("copy"))
    first = F.when(better(F.col("all")), F.col("all.id"))
    why = F.when(copied, "year+publisher").when(better(doubtful), "to check").when(first.isNotNull(), "different").otherwise("nothing like it")
    return df.select("lib", "id", F.when(copied, "trash").otherwise("leave").alias("action"), F.when(copied, F.col("copy.id")).otherwise(first).alias("match"), why.alias("why"))
