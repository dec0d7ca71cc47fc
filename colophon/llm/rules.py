"""Quality rules: counts for every document, and a log-likelihood ratio of hashed n-grams, DataFrame functions only.

Texts are cut into runs of word characters and runs of other signs; single tokens and pairs of
neighbours are hashed into BUCKETS. Two multinomials are estimated over the buckets: the raw corpus
from all documents, the trusted target from documents that ``trusted`` names. A document's score is
the mean log ratio of target to raw over its n-grams; documents below ``threshold`` go.
The tables that leave the cluster have BUCKETS rows.

Words in repeated windows are found by sorting the hashes of a text's windows, and only in texts whose
windows aren't all different.

Cases: null texts count as empty and have no words; a text without n-grams scores 0; a text of fewer than three words has no
windows; equal rows have equal results; null ids in ``trusted`` name nothing; with no trusted
documents every score is 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.llm.common import BLANKS

BUCKETS = 1 << 14
#: Trusted documents that the target is estimated from at most, the first by a hash of their ids.
TRUSTED_ROWS = 20_000
#: The mean log ratio from which a document stays.
THRESHOLD = -0.25
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
_PRIOR = 1.0
# The signs that n_symbols counts.
SIGNS = "#*$%&|<>"


def base_columns(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` (doc_id, text) and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = F.btrim(text, F.lit(BLANKS))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    df = docs.select("doc_id", "text", F.char_length(F.translate(text, BLANKS, "")).cast("bigint").alias("word_chars"), (F.char_length(text) - F.char_length(F.translate(text, SIGNS, ""))).cast("bigint").alias("n_symbols"), lines.alias("lines"), F.transform(words, lambda w: F.xxhash64(w)).alias("hashes"))
    windows = F.transform(F.slice("hashes", F.lit(1), F.greatest(F.size("hashes") - 2, F.lit(0))), lambda h, i: F.xxhash64(h, F.get("hashes", i + 1), F.get("hashes", i + 2)))
    df = df.select("doc_id", "text", "word_chars", "n_symbols", F.size("hashes").cast("bigint").alias("n_words"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"), windows.alias("windows"))
    ordered = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("ordered", ordered).drop("windows")
    same = lambda x, k: x["h"] == F.get("ordered", k)["h"]
    repeated = F.sort_array(F.transform(F.filter("ordered", lambda x, k: F.coalesce(same(x, k + 1), F.lit(False)) | F.coalesce(same(x, k - 1), F.lit(False))), lambda x: x["i"]))
    df = df.withColumn("starts", repeated).drop("ordered")
    start = F.struct(F.lit(-3).alias("before"), F.lit(0).cast("bigint").alias("n"))
    covered = F.aggregate("starts", start, lambda acc, i: F.struct(i.alias("before"), (acc["n"] + F.least(F.lit(3), i - acc["before"])).alias("n")), lambda acc: acc["n"])
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))).drop("starts")


def _grams(text: Column) -> Column:
    """Hashes of the text's tokens, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"), F.lit(0)), lambda t: F.xxhash64(t))


def _buckets(tokens: str) -> Column:
    """The buckets of single tokens and of neighbours."""
    low = lambda h: h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    single = F.transform(tokens, low)
    double = F.transform(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda h, i: low(F.xxhash64(h, F.get(tokens, i + 1))))
    return F.concat(single, double)


def log_ratios(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """log(target / raw) of each bucket; ``trusted(doc_id)`` names target documents."""
    few = trusted.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(TRUSTED_ROWS)
    flagged = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(few), F.col("doc_id") == F.col("_id"), "left")
    tokens = flagged.select(F.col("_id").isNotNull().alias("target"), _grams(F.col("text")).alias("tokens"))
    grams = tokens.select("target", F.explode(_buckets("tokens")).alias("bucket"))
    rows = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("target").alias("target")).collect()
    raw, target = [_PRIOR] * BUCKETS, [0.0] * BUCKETS
    for r in rows:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    n_raw, n_target = sum(raw), sum(target)
    if not n_target:
        return [0.0] * BUCKETS
    # the prior of the target is the raw corpus, so that unseen buckets say nothing
    weight = 10.0
    return [math.log((t + weight * r / n_raw) * n_raw / ((n_target + weight) * r)) if t else math.log(weight / (n_target + weight)) if r > _PRIOR else 0.0 for t, r in zip(target, raw, strict=True)]


def score(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """``docs`` with the mean log ratio of its n-grams in ``llr``."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    df = docs.withColumn("tokens", _grams(F.col("text")))
    df = df.withColumn("grams", _buckets("tokens")).drop("tokens")
    total = F.aggregate("grams", F.lit(0.0), lambda acc, g: acc + F.get(table, g))
    return df.withColumn("llr", F.when(F.size("grams") > 0, total / F.size("grams")).otherwise(F.lit(0.0))).drop("grams")


def apply_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: the counts, base_failed, llr and kept."""
    ratios = log_ratios(docs, trusted)
    df = score(base_columns(docs), ratios)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT)
    df = df.withColumn("base_failed", failed)
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("llr") >= threshold)).alias("kept"), F.round("llr", 9).alias("llr"))
