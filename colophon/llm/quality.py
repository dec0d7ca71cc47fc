"""Quality classifier: supervised subword embeddings.

A text's features are its words, the 3- and 4-byte grams of its words (with their borders), its pairs of
neighbouring words, and its windows of three words with the words replaced by which of them are equal, so that what is learned of
repeated words holds for words never seen. Each is hashed into one of ROWS rows of an embedding of WIDTH numbers. A document is the mean of its features'
vectors; a linear layer and a softmax give the class. Both are learned by stochastic gradient descent in
numpy, on a sample of labelled rows that is bounded in rows and in features, with equal weight for both classes.

Hashing runs over all bytes of a batch at once: grams from shifted copies, words from prefix sums of a
polynomial modulo 2**64. To score, each row's vector is first multiplied by the output layer,
so a document costs one lookup and sum for each feature.

Cases: null and empty texts have no features and score the output's bias; equal texts score equally;
null labels and ids are no labels; with one class only, every score is that class's share; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colophon.llm.common import arrow_map, crc_mod3, forget, held_out, written

ROWS, WIDTH = 1 << 16, 8
#: Labelled rows that the model is fitted on at most, the first by a hash of their ids, and the different
#: features that these rows may have together (8 bytes each on the driver); rows after the first that would exceed it aren't used.
TRAINING_ROWS, TRAINING_FEATURES = 3_000, 8_000_000
#: Learning rates of the output layer and, for each document, of the embedding: a row has a share of about a
#: thousandth in a document, so its gradient is that much smaller.
EPOCHS, RATE, EMBEDDING_RATE, BATCH, SEED = 12, 0.5, 20.0, 16, 20

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_PART = 1 << 20


def _inverse(p: int) -> int:
    return pow(p, -1, 1 << 64)


class Powers:
    """Powers of the polynomial's base and of its inverse."""

    up: np.ndarray = np.ones(1, np.uint64)
    down: np.ndarray = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _P)]), dtype=np.uint64)
            cls.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, np.uint64(_inverse(int(_P))))]), dtype=np.uint64)
        return cls.up[:n], cls.down[:n]


def _row(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(ROWS)).astype(np.int32)


def features(data: bytes) -> Iterator[np.ndarray]:
    """Rows of all features of a text's bytes, part by part; parts end at blanks where there are any."""
    at = 0
    while at < len(data):
        end = min(len(data), at + _PART)
        if end < len(data):
            cut = max(data.rfind(b" ", at + 1, end), data.rfind(b"\n", at + 1, end))
            end = cut if cut > at else end
        yield _features(b" " + data[at:end] + b" ")
        at = end


def _features(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    blank = _BLANK[b]
    b = np.where(blank, np.uint8(32), b).astype(np.uint64)
    inner = ~blank
    out = []
    # a gram has no blank inside; it may begin or end with one
    two, three = b[:-1] << np.uint64(8) | b[1:], b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]
    ok = inner[1:-1]
    out.append(_row(three[ok] + np.uint64(1 << 40)))
    if len(b) > 3:
        four = two[:-2] << np.uint64(16) | two[2:]
        out.append(_row(four[inner[1:-2] & inner[2:-1]] + np.uint64(2 << 40)))
    up, down = Powers.of(len(b))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((b + np.uint64(1)) * up, dtype=np.uint64)])
    starts, ends = np.flatnonzero(blank[:-1] & inner[1:]) + 1, np.flatnonzero(inner[:-1] & blank[1:]) + 1
    if len(starts):
        words = (sums[ends] - sums[starts]) * down[starts]
        out.append(_row(words + np.uint64(3 << 40)))
        out.append(_row((words[:-1] ^ (words[:-1] >> np.uint64(31))) * _P + words[1:] + np.uint64(4 << 40)))
        # windows of three words as patterns of equal and different words, whatever the words are
        same, apart = words[1:] == words[:-1], words[2:] == words[:-2]
        out.append(_row((same[:-1] + 2 * same[1:] + 4 * apart).astype(np.uint64) + np.uint64(5 << 40)))
    return np.concatenate(out)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Different rows of a text's features and how often each occurs."""
    counts = np.zeros(ROWS, np.int64)
    for part in features((text or "").encode("utf-8", "surrogatepass")):
        counts += np.bincount(part, minlength=ROWS)
    rows = np.flatnonzero(counts)
    return rows.astype(np.int32), counts[rows].astype(np.float32)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embedding, output layer and bias after EPOCHS of stochastic gradient descent."""
    rng = np.random.default_rng(SEED)
    emb = rng.uniform(-1 / WIDTH, 1 / WIDTH, (ROWS, WIDTH)).astype(np.float32)
    out, bias = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32), np.zeros(2, np.float32)
    share = np.array([(labels == k).mean() for k in (0, 1)])
    weight = (0.5 / share)[labels].astype(np.float32)
    shares = [c / c.sum() if len(c) else c for _, c in bags]
    steps, total = 0, EPOCHS * -(-len(bags) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            rate = RATE * (1 - steps / total) + 0.01
            steps += 1
            vectors = np.stack([shares[i] @ emb[bags[i][0]] if len(bags[i][0]) else np.zeros(WIDTH, np.float32) for i in some])
            z = vectors @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), labels[some]] -= 1
            p *= weight[some, None] / len(some)
            back = p @ out.T
            out -= rate * vectors.T @ p
            bias -= rate * p.sum(axis=0)
            for i, g in zip(some, back, strict=True):
                emb[bags[i][0]] -= (EMBEDDING_RATE * rate * len(some)) * shares[i][:, None] * g
    return emb, out, bias


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """What each embedding row adds to the log odds of class 1, and the bias."""
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality is not null").filter(crc_mod3(F.col("doc_id")) != 1)
    chosen = rows.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [bag(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in bags], pa.list_(pa.int32())), pa.array([c for _, c in bags], pa.list_(pa.float32())), batch.column(1), batch.column(2)], names=["rows", "counts", "quality", "doc_id"])

    sample = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").join(F.broadcast(chosen), "doc_id").select("text", "quality", "doc_id")
    bagged = written(arrow_map(sample, run, "rows array<int>, counts array<float>, quality int, doc_id bigint"), "bags")
    so_far = F.sum(F.size("rows")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id", F.size("rows"), F.xxhash64("rows")))
    got = bagged.withColumn("so_far", so_far).filter(F.col("so_far") <= TRAINING_FEATURES).select("rows", "counts", "quality", "doc_id", F.xxhash64("rows", "counts").alias("h")).toArrow()
    # rows that repeat an id stand by what they hold, so that the fit doesn't depend on the order of partitions
    got = got.sort_by([("doc_id", "ascending"), ("h", "ascending")])
    forget(bagged)
    y = got["quality"].to_numpy().astype(np.int64)
    if not 0 < y.sum() < len(y):
        p = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return np.zeros(ROWS, np.float64), float(np.log(p / (1 - p)))
    bags = [(np.asarray(r.values, np.int32), np.asarray(c.values, np.float32)) for r, c in zip(got["rows"], got["counts"], strict=True)]
    emb, out, bias = fit(bags, y)
    return emb.astype(np.float64) @ (out[:, 1] - out[:, 0]).astype(np.float64), float(bias[1] - bias[0])


def log_odds(text: str | None, rows: np.ndarray, bias: float) -> float:
    total, n = 0.0, 0
    for part in features((text or "").encode("utf-8", "surrogatepass")):
        total += float(rows[part].sum())
        n += len(part)
    return bias + (total / n if n else 0.0)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, bias = sent.value
        for batch in batches:
            z = np.array([log_odds(t, rows, bias) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=["doc_id", "score"])

    scored = arrow_map(docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text"), run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
