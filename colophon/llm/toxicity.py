"""Toxicity by a noisy channel: disguised words are restored by Viterbi decoding, then the text is scored.

1. Language model: character trigrams of all documents, counted in numpy over a fixed alphabet of 64
   symbols, so at most 64**3 sums reach the driver.
2. Channel: a span that looks disguised (confusable signs among letters, letters apart by spaces
   or points, letters repeated three times or more) becomes a lattice: each character may be read as
   itself, as one of the letters it stands for, or as nothing where it separates or
   repeats. Viterbi decoding under the model picks the reading. Other spans stay as they are.
3. Lexicon: words and word beginnings whose use in toxic training texts is well beyond that in
   clean ones. Support counts different neighbours, not documents, so that copies of one
   text add nothing. It is learned from a bounded sample of labelled rows.
4. Score: a logistic function of what the restored text has of the lexicon, fitted on each half of
   the sample with a lexicon learned from the other half alone.

Cases: null and empty texts score what a text without lexicon words scores; equal texts score
equally; repeated rows stay; null labels are no labels; without training rows of both kinds every score is
the prior 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.llm.common import arrow_map, crc_mod3, held_out, slices, written

#: Labelled rows that the classifier is fitted on at most, the first by a hash of their ids.
TRAINING_ROWS = 16_000
#: A lexicon entry has this log ratio of toxic to clean use, and so many different neighbours in toxic
#: training texts that CHANCE entries at most are expected to have them by chance.
RATIO, CHANCE = 3.0, 5
#: Texts after which a worker sends on what it has found.
FLUSH = 400
#: Lengths of word beginnings that are entries beside whole words.
BEGINNINGS = (4, 5)

# The alphabet of the character model, after the word border (0); any other letter is the last symbol.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøœùúûüÿß"
BORDER, OTHER, SYMBOLS = 0, len(LETTERS) + 1, 64
# The letters that a sign can stand for.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "*": "aeiou"}
SEPARATORS = " .-_*~'/,"
# Signs that end a word as punctuation.
ENDS = "!|+"

_COST = {"stands": 1.0, "dropped separator": 0.3, "dropped sign": 8.0, "repeat": 0.4}
_WORD = re.compile(r"[^\W\d_]+")
_SIGN = "".join(map(re.escape, STANDS_FOR))
_SPACED = re.compile(r"(?<![^\W_])[^\W_](?:[ .\-_*~/]{1,2}[^\W_]){2,}(?![^\W_])")
# a whole run of letters and signs that has both; what follows its start is matched in one way only
_MIXED = re.compile(rf"(?<![^\W\d_])(?<![{_SIGN}])(?:[^\W\d_]++[{_SIGN}]|[{_SIGN}]++[^\W\d_])(?:[^\W\d_]++|[{_SIGN}]++)*+")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
# what a code point is to the patterns
_ALNUM, _LETTER, _APART = 1, 2, 4


def _symbols() -> np.ndarray:
    """Symbol of every code point of the basic plane."""
    table = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        if chr(c).isalpha():
            table[c] = OTHER
    for i, c in enumerate(LETTERS):
        table[ord(c)] = i + 1
    return table


def _kinds() -> np.ndarray:
    """_ALNUM, _LETTER and _APART of every code point."""
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        if chr(c).isalnum():
            table[c] = _ALNUM if chr(c).isdecimal() else _ALNUM | _LETTER
    table[[ord(c) for c in " .-_*~/"]] = _APART
    return table


class Reader:
    """Tables that each worker makes once."""

    table: np.ndarray | None = None
    kind: np.ndarray | None = None

    @classmethod
    def codes(cls, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Code points and their kinds, between two borders."""
        if cls.kind is None:
            cls.kind = _kinds()
        codes = np.frombuffer(f"\n{text}\n".encode("utf-32-le", "surrogatepass"), np.uint32)
        return codes, cls.kind[codes]

    @classmethod
    def symbols(cls, text: str) -> np.ndarray:
        if cls.table is None:
            cls.table = _symbols()
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        return cls.table[np.minimum(codes, 0xFFFF)]


def trigrams(text: str) -> np.ndarray:
    """Indices of the trigrams of the text's words, with their borders."""
    s = Reader.symbols("  " + text + " ").astype(np.int32)
    two, one, now = s[:-2], s[1:-1], s[2:]
    two = np.where(one == BORDER, BORDER, two)
    return (two * SYMBOLS * SYMBOLS + one * SYMBOLS + now)[(one != BORDER) | (now != BORDER)]


class LanguageModel:
    """-log P(symbol | two symbols before), backing off by interpolation."""

    def __init__(self, counts: np.ndarray) -> None:
        c = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
        one = c.sum(axis=(0, 1)) + 0.5
        two = c.sum(axis=0) + 0.5
        p1 = one / one.sum()
        p2 = 0.9 * two / two.sum(axis=1, keepdims=True) + 0.1 * p1
        total = c.sum(axis=2, keepdims=True)
        trust = total / (total + 10)
        p3 = trust * c / np.maximum(total, 1) + (1 - trust) * p2[None]
        self.cost = -np.log(np.maximum(p3, 1e-9)).astype(np.float32)


def corpus_model(docs: DataFrame) -> np.ndarray:
    """Counts of all trigrams of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            held: list[str] = []
            size = 0
            for text in [*batch.column(0).to_pylist(), None]:
                if text is not None:
                    held.append(text)
                    size += len(text)
                if held and (text is None or size > 1 << 20):
                    total += np.bincount(trigrams("  ".join(held)), minlength=SYMBOLS**3)
                    held, size = [], 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])

    sums = arrow_map(docs.selectExpr("cast(text as string) text"), run, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    out = np.zeros(SYMBOLS**3, np.int64)
    for row in sums.collect():
        out[row.gram] = row.n
    return out


def may_be_spaced(kinds: np.ndarray) -> bool:
    """Does _SPACED match? It does where three letters stand alone, one or two separators apart."""
    alnum = (kinds & _ALNUM) != 0
    at = np.flatnonzero(alnum[1:-1] & ~alnum[:-2] & ~alnum[2:]) + 1
    if len(at) < 3:
        return False
    apart = (kinds & _APART) != 0
    near = (np.diff(at) <= 3) & apart[at[:-1] + 1] & apart[at[1:] - 1]
    return bool((near[1:] & near[:-1]).any())


def may_repeat(codes: np.ndarray, kinds: np.ndarray) -> bool:
    """Does _TRIPLE match?"""
    same = codes[1:] == codes[:-1]
    return bool((same[1:] & same[:-1] & ((kinds[2:] & _LETTER) != 0)).any())


class Decoder:
    """Restores disguised spans; readings of short spans are kept up to a fixed number."""

    KEPT, SHORT = 100_000, 64

    def __init__(self, counts: np.ndarray) -> None:
        self.cost, self.known = LanguageModel(counts).cost.tolist(), {}

    def _choices(self, c: str, before: str, last: bool = False) -> list[tuple[str, float]]:
        if c.isalpha():
            out = [(c, 0.0)]
            if c == before:
                out.append(("", _COST["repeat"]))
            return out
        out = [(x, _COST["stands"]) for x in STANDS_FOR.get(c, "")]
        out.append(("", _COST["dropped separator"] if c in SEPARATORS or last and c in ENDS else _COST["repeat"] if c == before else _COST["dropped sign"]))
        return out

    def span(self, span: str) -> str:
        """The most likely reading of one span as a word."""
        span = span.lower()
        if span not in self.known:
            if len(span) > self.SHORT or len(self.known) >= self.KEPT:
                return self._decode(span)
            self.known[span] = self._decode(span)
        return self.known[span]

    def _decode(self, span: str) -> str:
        """Viterbi over all states: the two symbols read last. There are at most SYMBOLS ** 2 of them, and no more in practice than the
        readings of neighbouring characters combine to, so none is cut."""
        # the best way to each state: its cost and what was read, a chain from the last symbol back
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(BORDER, BORDER): (0.0, None)}
        before, end = "", len(span.rstrip(ENDS))
        for i, c in enumerate(span):
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for read, price in self._choices(c, before, i >= end):
                symbol = int(Reader.symbols(read)[0]) if read else BORDER
                for (two, one), (cost, chain) in states.items():
                    state, total = ((one, symbol), cost + price + self.cost[two][one][symbol]) if read else ((two, one), cost + price)
                    if state not in after or total < after[state][0]:
                        after[state] = (total, (read, chain) if read else chain)
            states, before = after, c
        chain = min(((cost + self.cost[two][one][BORDER], k, chain) for k, ((two, one), (cost, chain)) in enumerate(states.items())), key=lambda x: x[:2])[2]
        out = []
        while chain is not None:
            read, chain = chain
            out.append(read)
        return "".join(reversed(out))

    def restore(self, text: str) -> str:
        """The text with each disguised span read as a word."""
        codes, kinds = Reader.codes(text)
        if may_be_spaced(kinds):
            text = _SPACED.sub(lambda m: self.span(m[0]) if sum(map(str.isalpha, m[0])) > 2 else m[0], text)
            codes, kinds = Reader.codes(text)
        if may_repeat(codes, kinds):
            text = self._without_repeats(text)
        if any(c in text for c in STANDS_FOR):
            text = _MIXED.sub(lambda m: self.span(m[0]), text)
        return text

    def _without_repeats(self, text: str) -> str:
        out, at = [], 0
        for m in _TRIPLE.finditer(text):
            start, end = m.span()
            if start < at:
                continue
            while start > at and text[start - 1].isalnum():
                start -= 1
            while end < len(text) and text[end].isalnum():
                end += 1
            out += [text[at:start], self.span(text[start:end])]
            at = end
        return "".join([*out, text[at:]])


def _entries(words: set[str]) -> set[str]:
    """The words and, marked by a full stop, their beginnings."""
    return words.union(*({w[:k] + "." for w in words if len(w) > k} for k in BEGINNINGS))


def _evidence(sample: DataFrame, counts: np.ndarray) -> DataFrame:
    """(entry, near, toxic, clean, half): different words before it in toxic texts, and texts with it."""

    kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
    names = ["entry", "half", "near", "toxic", "clean"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(counts)
        for batch in batches:
            # what is found goes out every FLUSH texts, and is summed by entry later
            for at in range(0, batch.num_rows, FLUSH):
                near: dict[tuple[int, str], set[int]] = defaultdict(set)
                toxic, clean = Counter(), Counter()
                for text, label, half in zip(*(c.to_pylist() for c in batch.slice(at, FLUSH).columns), strict=True):
                    words = _WORD.findall(decoder.restore(text or "").lower())
                    (toxic if label else clean).update((half, e) for e in _entries(set(words)))
                    if label:
                        for before, w in zip(["", *words], words, strict=False):
                            mark = hash_of(before)
                            for e in _entries({w}):
                                near[half, e].add(mark)
                keys = list({*toxic, *clean})
                for first in range(0, len(keys), 10_000):
                    rows = [(e, half, sorted(near.get((half, e), ())), toxic[half, e], clean[half, e]) for half, e in keys[first : first + 10_000]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return arrow_map(sample.selectExpr("cast(text as string) text", "toxic", "half"), run, "entry string, half bigint, near array<bigint>, toxic bigint, clean bigint")


def _lexicon(evidence: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """The strongest entries of evidence from so many toxic and clean texts."""
    if not toxic:
        return {}
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    sums = evidence.groupBy("entry").agg(F.size(F.array_distinct(F.flatten(F.collect_list("near")))).alias("neighbours"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # by chance, all of k uses are in toxic texts with probability share ** k
    candidates = evidence.filter("toxic > 0").select("entry").distinct().count()
    support = max(3, math.ceil(math.log(max(1, candidates) / CHANCE + 1) / -math.log(toxic / (toxic + clean + 1))))
    strong = sums.filter(F.col("neighbours") >= support).withColumn("weight", weight).filter(F.col("weight") >= RATIO)
    # bounded by the words of TRAINING_ROWS texts
    return {r.entry: float(r.weight) for r in strong.select("entry", "weight").collect()}


def hash_of(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word) >> 1


class Scorer:
    """What one worker needs to score texts."""

    def __init__(self, counts: np.ndarray, lexicon: dict[str, float], weights: list[float]) -> None:
        self.decoder, self.lexicon, self.weights = Decoder(counts), lexicon, weights
        self.words = {e for e in lexicon if not e.endswith(".")}
        self.starts = {k: {e[:-1] for e in lexicon if e.endswith(".") and len(e) == k + 1} for k in BEGINNINGS}

    def features(self, text: str | None) -> tuple[float, float, float]:
        """The square of the strongest entry (a tenth of it), the logarithms of the sum over different words of their strongest entries and of
        how many of a thousand words have one."""
        words = set(_WORD.findall(self.decoder.restore(text or "").lower()))
        found: dict[str, float] = {w: self.lexicon[w] for w in words & self.words}
        for k, starts in self.starts.items():
            if starts and (hits := {w[:k] for w in words} & starts):
                for w in words:
                    if len(w) > k and w[:k] in hits:
                        found[w] = max(found.get(w, 0.0), self.lexicon[w[:k] + "."])
        return max(found.values(), default=0.0) ** 2 / 10, math.log1p(sum(found.values())), math.log1p(1000 * len(found) / max(1, len(words)))

    def score(self, text: str | None) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> list[float]:
    """Newton's method with a small ridge; the first weight is the constant."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    ridge = np.eye(a.shape[1]) * 0.1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, dict[str, float], list[float]]:
    """Trigram counts of all documents, and lexicon and weights from labelled rows that aren't held out."""
    counts = corpus_model(docs)
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null").filter(crc_mod3(F.col("doc_id")) != 1)
    chosen = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS)
    sample = written(docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "text"]).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2))), "sample")
    size = Counter({(r.half, r.toxic): r["count"] for r in sample.groupBy("half", "toxic").count().collect()})
    toxic, clean = size[0, 1] + size[1, 1], size[0, 0] + size[1, 0]
    if not toxic or not clean:
        return counts, {}, [-30.0, 0.0, 0.0, 0.0]
    evidence = written(_evidence(sample, counts), "evidence")
    lexicon = _lexicon(evidence, toxic, clean)
    others = [_lexicon(evidence.filter(F.col("half") != k), size[1 - k, 1], size[1 - k, 0]) for k in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(counts, x, [0.0] * 4) for x in others]
        for batch in batches:
            x = np.array([scorers[half].features(t) for t, half in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i]) for i in range(3)), batch.column(1)], names=["a", "b", "c", "toxic"])

    seen = arrow_map(sample.select("text", "toxic", "half"), run, "a double, b double, c double, toxic int").toPandas()
    return counts, lexicon, fit_logistic(seen[["a", "b", "c"]].to_numpy(float), seen.toxic.to_numpy(float))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    counts, lexicon, weights = train(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast((counts, lexicon, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        for batch in batches:
            s = pa.array([scorer.score(t) for t in batch.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), s], names=["doc_id", "score"])

    scored = arrow_map(docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text"), run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents whose text isn't predicted toxic, with all their columns, whatever their names."""
    counts, lexicon, weights = train(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast((counts, lexicon, weights))
    at = docs.columns.index("text")
    # columns go by their places, so that no name can clash, and the text is carried once
    placed = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        for batch in slices(batches, f"c{at}"):
            yield batch.filter(pa.array([scorer.score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return placed.mapInArrow(run, placed.schema).toDF(*docs.columns)
