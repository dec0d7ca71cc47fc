"""Mixing sources to target weights by Pfair scheduling.

Each source's documents stand in a pseudo-random order and are cut into blocks of ``block``
documents. Time is cut into slots, one block each. Block i (from 1) of a source of weight w is released at
floor((i - 1) / w) and due by ceil(i / w); in each slot the released block with the earliest deadline is
scheduled. Since the weights sum to 1, every block meets its deadline, and at any time a source
has been given less than one block more or less than its weight times the time.

Weights are multiples of 1 / frame, so the schedule repeats after a frame of slots, where every source is
exactly on target. A frame has FRAME slots, or with many sources as many times FRAME as gives PER_SOURCE slots
to each on average; it is simulated once (one step a slot, whatever the documents) and joined to
the blocks by their number within their frame. Places in a source's order are counted within
hash ranges of bounded size and offset by running sums of the ranges, so a source of any share
is never in one task.

A source that is exhausted leaves its slots idle, and the others go on in the proportion of their weights, so the
mixture holds every document of every source with a weight, those of a last partial block too. Default
weights follow the square root of the source sizes, and every document is ``scheduled``. With given weights ``scheduled``
says how long all of them are met: it is false from the slot of the first whole block that some source lacks.

Each row has a key of its own, given once and written, so the order of a source doesn't depend on ids being there or being different.

Cases: a null source is a source of its own; rows that are equal, without an id or of one id take different places of the same source; a
source of weight 0, or one not named in given weights, is never scheduled; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colophon.llm.common import ROW, wrapped, written
from colophon.operators.tables import bounded

FRAME, PER_SOURCE = 1024, 8
#: Slots of a frame up to which the calendar is broadcast.
SMALL = 1 << 17
#: Rows of slots up to which they are broadcast to the documents.
SLOTS = 2_000_000
#: Documents in one hash range, on average.
RANGE = 2_000
BLOCK = 8


def frame_size(sources: int) -> int:
    return FRAME * max(1, -(-sources * PER_SOURCE // FRAME))


def quantized(weights: dict, frame: int = FRAME) -> dict:
    """Weights as whole numbers of slots in a frame, by largest remainders; positive ones get a slot at least."""
    positive = {k: float(w) for k, w in weights.items() if w > 0}
    if not positive:
        return {}
    if len(positive) > frame:
        raise ValueError("more sources than slots in a frame")
    total = sum(positive.values())
    exact = {k: w / total * frame for k, w in positive.items()}
    slots = {k: max(1, math.floor(x)) for k, x in exact.items()}
    order = sorted(positive, key=lambda k: (slots[k] - exact[k], str(k)))
    i = 0
    while sum(slots.values()) != frame:
        short = sum(slots.values()) < frame
        k = order[i % len(order)] if short else order[-1 - i % len(order)]
        if short or slots[k] > 1:
            slots[k] += 1 if short else -1
        i += 1
    return slots


def pfair(slots: dict, frame: int = FRAME) -> list:
    """The source of each slot of a frame, by earliest deadline first among released blocks."""
    waiting = [(0, str(k), k, 1) for k in slots]
    heapq.heapify(waiting)
    ready: list = []
    out = []
    for t in range(frame):
        while waiting and waiting[0][0] <= t:
            _, name, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-i * frame // slots[k]), name, k, i))
        due, name, k, i = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("a deadline was missed")
        out.append(k)
        if i < slots[k]:
            heapq.heappush(waiting, (i * frame // slots[k], name, k, i + 1))
    return out


def places(rows: DataFrame) -> DataFrame:
    """(doc_id, source, key, place): ``rows(doc_id, source, key)``, numbered from 0 in pseudo-random order within each source.

    The order comes from the id and the row's own ``key``, so rows without an id, or of one id, are spread like all others.
    """
    ranges = max(1, -(-rows.count() // RANGE))
    keyed = rows.withColumn("h", F.xxhash64("doc_id", "key", F.lit(11))).withColumn("range", F.pmod(F.col("h"), F.lit(ranges)))
    keyed = keyed.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    sizes = keyed.groupBy("source_key", "range").count()
    before = Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("source_key", "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("source_key", "range").orderBy("h", "doc_id", "key"))
    return keyed.withColumn("within", within).join(offsets, ["source_key", "range"]).select("doc_id", "source", "key", "source_key", (F.col("offset") + F.col("within") - 1).alias("place"))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, source, key) of every row; the keys are only stable once the frame is written."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.monotonically_increasing_id().alias("key"))


def schedule(docs: DataFrame, weights: dict | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, source, block (from 0 in its source), slot (null without weight) and scheduled of every document.

    ``weights`` maps sources (None for null) to numbers; by default the square roots of their sizes.
    """
    return _scheduled(written(_keyed(docs), "keys"), weights, block).drop("key")


def _scheduled(docs: DataFrame, weights: dict | None, block: int) -> DataFrame:
    """The schedule of ``docs(doc_id, source, key)``, with the key."""
    spark = docs.sparkSession
    sizes = {r["source"]: r["count"] for r in docs.groupBy("source").count().collect()}
    wanted = {k: math.sqrt(n) for k, n in sizes.items()} if weights is None else {k: w for k, w in weights.items() if k in sizes}
    length = frame_size(sum(w > 0 for w in wanted.values()))
    slots = quantized(wanted, length)
    seen: dict = {k: [] for k in slots}
    for t, k in enumerate(pfair(slots, length) if slots else []):
        seen[k].append(t)
    small = F.broadcast if length <= SMALL else (lambda df: df)
    key = lambda k: "" if k is None else f"s{k}"
    calendar = spark.createDataFrame([(key(k), i, t) for k, at in seen.items() for i, t in enumerate(at)], "source_key string, nth bigint, t bigint")
    shares = spark.createDataFrame([(key(k), n) for k, n in slots.items()], "source_key string, share bigint")
    placed = places(docs).withColumn("block", F.floor(F.col("place") / block)).join(small(shares), "source_key", "left")
    numbered = placed.withColumn("nth", F.col("block") % F.col("share")).withColumn("frame", F.floor(F.col("block") / F.col("share")))
    slot = F.col("frame") * length + F.col("t")
    scheduled = slot.isNotNull()
    if weights is not None:
        # the slot of the first whole block that a source lacks
        scheduled &= slot < min((sizes[k] // block // slots[k] * length + at[sizes[k] // block % slots[k]] for k, at in seen.items()), default=0)
    return numbered.join(small(calendar), ["source_key", "nth"], "left").select("doc_id", "source", "key", F.col("block").cast("bigint").alias("block"), slot.cast("bigint").alias("slot"), scheduled.alias("scheduled"))


def mix(docs: DataFrame, weights: dict | None = None, block: int = BLOCK) -> DataFrame:
    """All documents of sources with a weight, with all their columns, in the order of their slots.

    Every row has a slot of its own, also if it has no id or another's. The rows are written once with their keys, slots are joined to them
    by the key, from a broadcast where their table is small, and texts are dealt by ranges of slots.
    """
    ids = F.col("doc_id").cast("bigint").alias("own")
    rows = written(wrapped(docs, ids, F.col("source").cast("string").alias("source"), F.monotonically_increasing_id().alias("key")), "rows")
    slots = _scheduled(rows.select(F.col("own").alias("doc_id"), "source", "key"), weights, block).filter("slot is not null")
    slots = written(slots.select(F.col("key").alias("of"), "slot"), "slots")
    joined = rows.join(bounded(slots, SLOTS), F.col("key") == F.col("of"))
    return joined.repartitionByRange("slot", "own", "key").sortWithinPartitions("slot", "own", "key").select(f"{ROW}.*")
