"""SimHash near-duplicates: a positional byte index with count filtering, then components.

Fingerprints that differ in at most ``bits`` of 64 bits differ in at most ``bits`` of their
eight bytes, so they share at least 8 - bits positional bytes. The inverted index posts every distinct
fingerprint under its positional bytes. Postings of a single byte would each hold 1/256 of all
fingerprints, so each has a prefix: a group of other positions with their bytes, the groups chosen so that any two
fingerprints sharing the guaranteed minimum agree on a whole group. Each posting in which a pair meets
is one shared byte beyond the group; they are counted per pair and group, pairs below
the minimum go, and the rest are verified by their bits.

Texts with equal fingerprints are one class from the start, so copies are never paired.

Cases: null texts are empty; texts without words have fingerprint zero and link like any other;
fewer than three words make one shingle; equal rows share a class; a null doc_id is a row like
others, and only names a class whose ids are all null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.llm.common import ROW, arrow_map, wrapped, written
from colophon.operators.components import components
from colophon.operators.tables import bounded, exchanged, forget

WIDTH, SEED = 3, 42
#: Rows of ids up to which they are broadcast to the documents; more take too much of a driver's memory.
SMALL = 500_000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_STEP = 1 << 16


def fingerprint(text: str | None) -> int:
    """The 64-bit majority of the hashes of the text's shingles of three words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < WIDTH:
        return digest(b" ".join(words), SEED)
    total, n = np.zeros(64, np.int64), len(words) - WIDTH + 1
    for at in range(0, n, _STEP):
        part = words[at : at + _STEP + WIDTH - 1]
        hashes = np.array([digest(b"%b %b %b" % s, SEED) for s in zip(part, part[1:], part[2:], strict=False)], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return arrow_map(docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text"), run, "doc_id bigint, fp bigint")


def position_groups(shared: int, size: int) -> list[tuple[int, ...]]:
    """Groups of ``size`` of eight byte positions such that any ``shared`` positions hold one whole.

    Positions are dealt into rows; all groups within a row are taken. A row of k positions and
    r rows guarantee it when one row must hold ``size`` of the shared ones: shared > r * (size - 1).
    """
    rows = (shared - 1) // (size - 1) if size > 1 else 1
    dealt = [tuple(range(8))[i::rows] for i in range(rows)]
    return [g for row in dealt for g in combinations(row, size)]


def _mask(positions: tuple[int, ...]) -> int:
    m = sum(0xFF << 8 * p for p in positions)
    return m - (1 << 64) if m >> 63 else m


def postings(distinct: DataFrame, groups: list[tuple[int, ...]]) -> DataFrame:
    """(group, position, bytes, fp): each fingerprint under every byte outside every group, ``bytes`` holding that byte and the group's."""
    keys = [(i, p, _mask((*g, p))) for i, g in enumerate(groups) for p in range(8) if p not in g]
    return distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("group"), F.lit(p).alias("position"), F.lit(m).alias("mask")) for i, p, m in keys))).alias("k")).select("k.group", "k.position", F.col("fp").bitwiseAND(F.col("k.mask")).alias("bytes"), "fp")


def links(distinct: DataFrame, bits: int = 3, size: int = 3) -> DataFrame:
    """(a, b) with a < b for distinct fingerprints ``fp`` differing in 1 to ``bits`` bits.

    ``size`` is the number of positions in a posting's prefix: 3 (four bytes a posting) suits up to some 10**9
    distinct fingerprints, 4 more; the links are the same for every size.
    """
    shared = 8 - bits
    if not 1 <= size < shared:
        raise ValueError("a prefix must have fewer bytes than are guaranteed to be shared")
    post = postings(distinct, position_groups(shared, size))
    a, b = exchanged(post.alias("a")), exchanged(post.alias("b"))
    met = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("group", "position", "bytes")] + [F.col("a.fp") < F.col("b.fp")])
    tally = met.groupBy("a.group", F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).agg(F.count("*").alias("n"))
    enough = tally.filter(F.col("n") + size >= shared)
    return enough.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, bits: int = 3, size: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links."""
    marked = written(fingerprints(docs), "fingerprints")
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(classes.select("fp"), bits, size))
    rooted = written(classes.join(roots, classes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "classes")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = written(rooted.join(lowest, "root").select("fp", "component_id"), "named")
    forget(rooted)
    return exchanged(marked).join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, bits: int = 3) -> DataFrame:
    """The rows of each group's smallest doc_id; rows without an id stay (nothing names them).

    Rows that repeat that doc_id stay as well; they are one document.
    """
    found = near_duplicates(docs, bits)
    gone = written(found.filter("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays")).filter("not stays").select("doc_id"), "gone")
    rows = wrapped(docs, F.col("doc_id").cast("bigint").alias("own"))
    return rows.join(bounded(gone, SMALL), F.col("own") == F.col("doc_id"), "left_anti").select(f"{ROW}.*")
