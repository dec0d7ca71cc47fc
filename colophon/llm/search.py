"""Ranked lexical search: term-bucketed postings, integer scores, the best documents of each item.

1. Each text's terms are counted once, in bytes: signs become blanks, A-Z become small, the rest is split. The counts of
   each document are written, with a number for its row; number of documents and of terms are sums over them.
2. Postings (term, document, frequency, length factor) of the terms that items ask for are dealt by term bucket and document shard,
   so a term that every document holds lies in as many shards as there are documents for, and written.
3. A term's weight comes from the postings' counts. Each posting is scored once, whatever the number of items that ask for its term.
4. Scored postings are dealt by document before the items are joined on the term: sums per item and document then need no
   exchange of matches, which are many times the postings. A window keeps the first ``k`` of each item; it
   cuts each task's rows to k per item before they are exchanged.

Weights are floor(1000 ln((2 N + 2) / (2 df + 1))); a document of n terms has m = 100 - b + (b n N) div L; a match scores
w ((10**9 tf) div (1000 tf + 8 m)), all in 64-bit integers.

Cases: a null or empty text has no terms and isn't counted in N; each row is a document of its own, rows that repeat an
id too; equal scores stand in the order of ids, null ids last; an item without terms, or whose terms no document holds, has no
rows; rows that repeat an item_id are one item with the terms of all; an empty table gives no rows; texts of any
length are counted in parts of STEP bytes; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colophon.llm.common import arrow_map, written
from colophon.operators.tables import bounded

#: Bytes of a text whose terms are split at once, and of texts whose counts a worker holds.
STEP, HELD = 4 << 20, 1 << 20
#: Term buckets, and documents of one shard of a bucket.
BUCKETS, SHARD = 64, 50_000
#: Rows of item terms, or of weights, up to which they are broadcast.
SMALL = 1_000_000

# What is no term: ASCII but for letters and digits. All bytes of other characters are part of a term.
_FOLD = bytes(ord(" ") if b < 128 and not chr(b).isalnum() else b + 32 if 65 <= b <= 90 else b for b in range(256))


def term_counts(text: str | None) -> Counter:
    """How often each term (as bytes) stands in a text."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
    counts: Counter = Counter()
    at = 0
    while at < len(data):
        end = data.find(b" ", at + STEP)
        end = len(data) if end < 0 else end
        counts.update(data[at:end].split())
        at = end
    return counts


_COUNTED = "doc_id bigint, n bigint, terms array<string>, tfs array<bigint>"


def counted(df: DataFrame, key: str) -> DataFrame:
    """(key, n, terms, tfs) of every row: how many terms its text has, and each one's frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ = [term_counts(t) for t in batch.column(1).to_pylist()]
            starts = np.concatenate([[0], np.cumsum([len(c) for c in all_])]).astype(np.int32)
            terms = pa.array([t for c in all_ for t in c], pa.binary()).cast(pa.string())
            tfs = pa.array([n for c in all_ for n in c.values()], pa.int64())
            lists = [pa.ListArray.from_arrays(pa.array(starts), x) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.total() for c in all_], pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return arrow_map(df.select(F.col(key).cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), run, _COUNTED, HELD)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term) of every item, each term once."""
    return counted(items, "item_id").select(F.col("doc_id").alias("item_id"), F.explode("terms").alias("term")).distinct()


def postings(docs: DataFrame, terms: DataFrame, documents: int) -> DataFrame:
    """(bucket, term, doc, doc_id, n, tf) of ``terms(term)`` in ``docs``, as ``counted`` gives them with a number ``doc`` of each row."""
    each = docs.select("doc", "doc_id", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("doc", "doc_id", "n", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))
    found = each.join(bounded(terms, SMALL), "term")
    shards = max(1, -(-documents // SHARD))
    bucket, shard = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)), F.pmod(F.xxhash64("doc"), F.lit(shards))
    return found.withColumn("bucket", bucket).repartition("bucket", shard).select("bucket", "term", "doc", "doc_id", "n", "tf")


def search(docs: DataFrame, items: DataFrame, k: int = 10, b: int = 90, saturation: int = 8) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of the highest positive score for each item.

    ``b`` is the share of a document's length in its factor in percent, ``saturation`` the tenths of k1.
    """
    table = written(counted(docs, "doc_id").withColumn("doc", F.monotonically_increasing_id()), "counted")
    asked = written(item_terms(items), "asked")
    total = table.agg(F.count_if(F.col("n") > 0).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    terms = written(asked.select("term").distinct(), "terms")
    index = written(postings(table, terms, total.N), "postings")
    weight = F.floor(1000 * F.log((2 * F.lit(total.N) + 2).cast("double") / (2 * F.col("df") + 1)))
    weights = written(index.groupBy("bucket", "term").agg(F.count("*").alias("df")).select("bucket", "term", weight.cast("bigint").alias("w")), "weights")
    m = f"({100 - b} + ({b} * n * {total.N}L) div {max(1, total.L)}L)"
    scored = index.join(bounded(weights, SMALL), ["bucket", "term"]).select("bucket", "term", "doc", "doc_id", F.expr(f"w * ((1000000000 * tf) div (1000 * tf + {saturation} * {m}))").alias("score")).filter("score <> 0")
    wanted = asked.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)))
    matches = scored.repartition("doc").join(bounded(wanted, SMALL), ["bucket", "term"])
    sums = matches.groupBy("item_id", "doc", "doc_id").agg(F.sum("score").alias("score")).filter("score > 0")
    first = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "doc")
    return sums.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
