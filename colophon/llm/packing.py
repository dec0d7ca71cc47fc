"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Every document becomes pieces of at most ``capacity`` tokens (its ids and one end id); only longer
documents are cut, their first piece being the short one. Whole pieces are sequences by
themselves. The others are dealt by a hash into cells of about CELL items. Each cell is
evolved on several islands: a chromosome is a grouping of items into bins; crossover injects whole
well-filled bins of one parent into the other, removes the bins that hold duplicates, and best-fits the
displaced items; mutation empties the worst bins. After a first epoch each island's elite migrates to
the next island of its cell, a second epoch follows, and the best island's grouping counts. Items of
bins that stay poorly filled go to a further round with fewer cells, until one cell is left
or a round fills too few bins well (``gain``: less than that share of its items). An island stops early once it meets the lower bound.

A cell holds a fixed number of items whatever the keys are, so no task grows with the input.

Cases: null texts are empty and give one piece with the end id alone; a repeated row is packed once for each
row; an empty table gives no rows; other columns are ignored; lengths must be 1 to ``capacity``.
"""

from __future__ import annotations

import random
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colophon.llm.common import arrow_map, written
from colophon.llm.tokens import encoder

CELL, ISLANDS, POPULATION, GENERATIONS = 2000, 2, 4, 30
#: A bin is well filled, and its items are done, from this share of the capacity on.
WELL = 0.98
#: Share of a round's items that must end in well-filled bins for a further round to be started; the items keep their bins otherwise.
GAIN = 0.3

Bins = list[list[int]]


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Martello and Toth's bound: for each k, items over capacity - k stand alone, small ones fill up."""
    best = -(-int(sizes.sum()) // capacity)
    count = np.bincount(sizes, minlength=capacity + 1)
    mass = np.cumsum(count * np.arange(capacity + 1))
    upto = np.cumsum(count)
    half = capacity // 2
    for k in range(0, half + 1):
        large = upto[capacity] - upto[capacity - k]
        middle, middle_mass = upto[capacity - k] - upto[half], mass[capacity - k] - mass[half]
        small_mass = mass[half] - (mass[k - 1] if k else 0)
        over = small_mass - (middle * capacity - middle_mass)
        best = max(best, int(large + middle + max(0, -(-over // capacity))))
    return best


def best_fit(sizes: list[int], items: list[int], bins: Bins, free: list[int], capacity: int) -> None:
    """Puts items, in their order, into the bins that they fill best, opening bins as needed."""
    open_, mask = defaultdict(list), 0
    for b, f in enumerate(free):
        if f:
            open_[f].append(b)
            mask |= 1 << f
    for i in items:
        s = sizes[i]
        fits = mask >> s
        if fits:
            f = s + (fits & -fits).bit_length() - 1
            stack = open_[f]
            b = stack.pop()
            if not stack:
                mask ^= 1 << f
        else:
            b, f = len(bins), capacity
            bins.append([])
            free.append(capacity)
        bins[b].append(i)
        f -= s
        free[b] = f
        if f:
            open_[f].append(b)
            mask |= 1 << f


def _free(sizes: list[int], bins: Bins, capacity: int) -> list[int]:
    return [capacity - sum(sizes[i] for i in b) for b in bins]


def _fitness(sizes: list[int], bins: Bins, capacity: int) -> tuple[int, float]:
    """Fewer bins are better, then more uneven ones: smaller is better."""
    return len(bins), -sum((capacity - f) ** 2 for f in _free(sizes, bins, capacity))


def _mend(sizes: list[int], kept: Bins, displaced: list[int], capacity: int) -> Bins:
    bins = [list(b) for b in kept]
    free = _free(sizes, bins, capacity)
    best_fit(sizes, sorted(displaced, key=lambda i: -sizes[i]), bins, free, capacity)
    return bins


def crossover(sizes: list[int], mother: Bins, father: Bins, capacity: int, rng: random.Random) -> Bins:
    """Well-filled bins of the father enter the mother; what they displace is fitted anew."""
    free = _free(sizes, father, capacity)
    good = sorted(range(len(father)), key=lambda b: free[b])[: max(1, len(father) // 2)]
    injected = [father[b] for b in rng.sample(good, max(1, len(good) // 2))]
    taken = {i for b in injected for i in b}
    kept, displaced = list(injected), []
    for b in mother:
        if taken.isdisjoint(b):
            kept.append(b)
        else:
            displaced += [i for i in b if i not in taken]
    return _mend(sizes, kept, displaced, capacity)


def mutate(sizes: list[int], bins: Bins, capacity: int, rng: random.Random) -> Bins:
    """Empties the worst bins and some others."""
    free = _free(sizes, bins, capacity)
    worst = sorted(range(len(bins)), key=lambda b: -free[b])[: max(2, len(bins) // 50)]
    gone = {*worst, *rng.sample(range(len(bins)), min(len(bins), 2 * len(worst)))}
    displaced = [i for b in gone for i in bins[b]]
    rng.shuffle(displaced)
    kept = [list(b) for k, b in enumerate(bins) if k not in gone]
    left = _free(sizes, kept, capacity)
    best_fit(sizes, displaced, kept, left, capacity)
    return kept


def evolve(sizes: list[int], population: list[Bins], capacity: int, generations: int, rng: random.Random) -> Bins:
    """The best grouping after so many generations, or once it meets the lower bound."""
    bound = lower_bound(np.asarray(sizes), capacity)
    ranked = sorted(((_fitness(sizes, p, capacity), k, p) for k, p in enumerate(population)), key=lambda x: x[:2])
    for g in range(generations):
        if ranked[0][0][0] <= bound:
            break
        mother, father = (min(rng.sample(ranked, 2), key=lambda x: x[:2])[2] for _ in range(2)) if len(ranked) > 1 else (ranked[0][2],) * 2
        child = crossover(sizes, mother, father, capacity, rng)
        if rng.random() < 0.5 or mother is father:
            child = mutate(sizes, child, capacity, rng)
        ranked = sorted([*ranked[: POPULATION - 1], (_fitness(sizes, child, capacity), len(population) + g, child)], key=lambda x: x[:2])
    return ranked[0][2]


def first_population(sizes: list[int], capacity: int, rng: random.Random) -> list[Bins]:
    """Best fit of the items by falling size, and of orders disturbed more and more."""
    out = []
    for k in range(POPULATION):
        order = sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 + 0.1 * k * rng.random()))
        bins: Bins = []
        best_fit(sizes, order, bins, [], capacity)
        out.append(bins)
        if k == 0 and len(bins) <= lower_bound(np.asarray(sizes), capacity):
            break
    return out


_STATE = "cell bigint, island int, uid bigint, length int, bin int, bins int, square double"


def _island(capacity: int):
    """Evolves one island of one cell: from nothing, or from its own and the migrated elite."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        cell, island = int(key[0]), int(key[1])
        frame = frame.sort_values(["origin", "uid"], kind="stable")
        items = frame[frame.origin == frame.origin.iloc[0]]
        uids, sizes = items.uid.to_numpy(), [int(x) for x in items.length]
        rng = random.Random(cell * 1009 + island * 31 + len(frame))
        population = []
        for _, elite in frame[frame.bin >= 0].groupby("origin", sort=True):
            grouping = defaultdict(list)
            for i, b in enumerate(elite.bin):
                grouping[b].append(i)
            population.append(list(grouping.values()))
        bins = evolve(sizes, population or first_population(sizes, capacity, rng), capacity, GENERATIONS, rng)
        number = np.empty(len(sizes), np.int32)
        for b, members in enumerate(bins):
            number[members] = b
        score = _fitness(sizes, bins, capacity)
        return pd.DataFrame({"cell": cell, "island": np.int32(island), "uid": uids, "length": np.asarray(sizes, np.int32), "bin": number, "bins": np.int32(score[0]), "square": float(score[1])})

    return run


def group_items(items: DataFrame, capacity: int, cells: int, salt: int) -> DataFrame:
    """(uid, length, cell, bin): one round of the algorithm over ``items(uid, length)``."""
    cell = F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(cells))
    start = items.select("uid", F.col("length").cast("int").alias("length"), cell.alias("cell"), F.explode(F.array(*(F.lit(i) for i in range(ISLANDS)))).alias("island"), F.lit(-1).alias("bin"), F.lit(0).alias("origin"))
    first = written(start.groupBy("cell", "island").applyInPandas(_island(capacity), _STATE), "islands")
    own = first.select("cell", "island", "uid", "length", "bin", F.lit(0).alias("origin"))
    guest = first.select("cell", ((F.col("island") + 1) % ISLANDS).alias("island"), "uid", "length", "bin", F.lit(1).alias("origin"))
    second = written(own.union(guest).groupBy("cell", "island").applyInPandas(_island(capacity), _STATE), "islands")
    best = second.groupBy("cell").agg(F.min(F.struct("bins", "square", "island")).alias("best")).select("cell", F.col("best.island").alias("island"))
    return second.join(best, ["cell", "island"]).select("uid", "length", "cell", "bin")


def pack(items: DataFrame, capacity: int = 1024, gain: float = GAIN) -> DataFrame:
    """(uid, sequence_id, offset) of ``items(uid, length)``; uid is unique, sequence_id the smallest uid of the sequence.

    Rounds go on until one cell is left or a round puts less than the share ``gain`` of its items into well-filled bins.
    """
    whole = items.filter(F.col("length") == capacity).select("uid", "length", F.col("uid").alias("sequence_id"))
    left = items.filter(F.col("length") < capacity).select("uid", "length")
    done, n, salt = [whole], left.count(), 0
    while n:
        cells = -(-n // CELL)
        grouped = group_items(left, capacity, cells, salt)
        w = Window.partitionBy("cell", "bin")
        placed = written(grouped.select("uid", "length", F.min("uid").over(w).alias("sequence_id"), F.sum("length").over(w).alias("fill")), "placed")
        poor = placed.filter(F.col("fill") < WELL * capacity)
        left, before = poor.select("uid", "length"), n
        n = left.count() if cells > 1 else 0
        if not n or before - n < gain * before:
            done.append(placed.select("uid", "length", "sequence_id"))
            break
        done.append(placed.filter(F.col("fill") >= WELL * capacity).select("uid", "length", "sequence_id"))
        salt += 1
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    order = Window.partitionBy("sequence_id").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    return out.select("uid", "sequence_id", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("bigint").alias("offset"))


PIECE_COLUMNS = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end: int = 2) -> DataFrame:
    """PIECE_COLUMNS of every document: its ids and the end id, cut where they are too many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(vocabulary).ids
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*ids_of(text or ""), end], "<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                rows += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names=[x.split()[0] for x in PIECE_COLUMNS.split(", ")])

    return arrow_map(docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text"), run, PIECE_COLUMNS)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024, end: int = 2) -> DataFrame:
    """The pieces of all documents with the sequence and the place there that each has."""
    cut = written(pieces(docs, vocabulary, capacity, end).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    return cut.join(pack(cut.select("uid", "length"), capacity), "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
