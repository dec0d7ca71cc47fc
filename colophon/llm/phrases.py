"""Phrase collocation mining by count tries of limited depth.

1. A shard is WORDS words of whole texts, in order, with marks where pieces end. Its words get numbers in byte order, and the windows of
   one or two words become whole numbers that sort like the paths of a trie; runs of equal ones are the trie's counted nodes.
2. A shard's trie is serialised sorted, in blocks of NODES nodes with a dictionary of their words, and written. Prefix ranges of about RANGE nodes
   each are cut from the blocks' first paths; a prefix that is too common for one range spans several. Every node goes to its
   range, blocks being parted where they span several, and a task merges the sorted blocks of a range and keeps what occurs ``least`` times.
3. A phrase of three words can't occur more often than the pairs in it, so the second tries, of three levels, only hold windows whose
   two pairs are in a bitmap of the frequent pairs. The bitmap has BITS bits whatever the corpus is; a pair that is in it by chance
   costs a node and changes no count.
4. Frequent nodes of all levels are walked in trie order: the path from the root gives every node the counts of its left
   parts. Where a range begins inside a subtree, the count of its first word is looked up, one for each range. Suffix
   links, joins on the path without its first words, give the counts of the right parts.
5. A candidate's lowest-scoring cut counts. Pairs that a frequent longer phrase covers are dropped by the largest count of such
   phrases. A window keeps the first ``top`` of each language.

Counts and products are exact (decimals of 38 digits).

Cases: null texts have no words, a null lang is ``und``; repeated rows count each; a text of any length is cut into shards of WORDS
words that overlap where windows need it; ties stand by occurrences, then by the bytes of the phrase; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colophon.llm.common import arrow_map, written
from colophon.operators.tables import bounded

#: Words of one shard's trie, at most; three of their numbers fit into 63 bits.
WORDS = 500_000
#: Bytes of a text that are split at once.
STEP = 8 << 20
#: Nodes of a block (whose codes fit into 16 bits), and of a prefix range about; first paths of blocks that are looked at for each range.
NODES, RANGE, LOOKED_AT = 512, 250_000, 50
#: Bits of the map of frequent pairs.
BITS = 1 << 25
#: Rows of frequent nodes, or of what is looked up in them, up to which they are broadcast.
SMALL = 500_000

_END = b"\xff"
# A-Z small, what ends a piece as a byte that no text has.
_FOLD = bytes(0xFF if chr(b) in ".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))

NODE = "lang string, w1 string, w2 string, w3 string, f bigint"
_NAMES = ["lang", "w1", "w2", "w3", "f"]


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """The text's words, with _END where pieces end, in parts."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
    at = 0
    while at < len(data):
        end = min((i for i in (data.find(x, at + STEP) for x in (b" ", b"\t", _END)) if i >= 0), default=len(data))
        yield data[at:end].replace(_END, b" \xff ").split()
        at = end


def _hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


def pair_bits(lang: str, first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    """The pairs' places in a bitmap of so many bits, from the words' hashes."""
    with np.errstate(over="ignore"):
        h = (first * np.uint64(0x9E3779B97F4A7C15)) ^ (second + np.uint64(xxhash.xxh3_64_intdigest(lang.encode())))
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(32)) % np.uint64(bits)


def _counted(path: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct paths and their (summed) counts."""
    if not len(path):
        return path, np.zeros(0, np.int64)
    order = np.argsort(path, kind="stable") if counts is not None else None
    path = np.sort(path) if counts is None else path[order]
    starts = np.concatenate([[0], 1 + np.flatnonzero(path[1:] != path[:-1])])
    sums = np.diff(np.append(starts, len(path))) if counts is None else np.add.reduceat(counts[order], starts)
    return path[starts], sums.astype(np.int64)


class Windows:
    """The windows of one lang in a shard: where they begin, and the trie of some of them."""

    def __init__(self, lang: str, codes: np.ndarray, begin: np.ndarray, words: pa.Array) -> None:
        self.lang, self.codes, self.words = lang, codes, words
        end = pc.index(words, pa.scalar(_END, pa.binary())).as_py()
        self.at = [begin[codes[begin] != end]]
        for k in (1, 2):
            at = self.at[-1][self.at[-1] + k < len(codes)]
            self.at.append(at[codes[at + k] != end])

    def pairs(self) -> Iterator[pa.RecordBatch]:
        """The trie of one and two words."""
        one, two = self.at[:2]
        w = len(self.words).bit_length()
        path = np.concatenate([self.codes[one] << w, (self.codes[two] << w) | (self.codes[two + 1] + 1)])
        path, counts = _counted(path)
        return blocks(self.lang, [path >> w, path & ((1 << w) - 1)], counts, self.words)

    def triples(self, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The trie of three words, without windows of pairs that aren't in the map."""
        at, w, hashes = self.at[2], len(self.words).bit_length(), _hashes(self.words)
        for k in (0, 1):
            place = pair_bits(self.lang, hashes[self.codes[at + k]], hashes[self.codes[at + k + 1]], 8 * len(frequent))
            at = at[(frequent[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        path, counts = _counted((self.codes[at] << (2 * w)) | (self.codes[at + 1] + 1) << w | (self.codes[at + 2] + 1))
        mask = (1 << w) - 1
        return blocks(self.lang, [path >> (2 * w), (path >> w) & mask, path & mask], counts, self.words)


_BLOCK = ["lang", "first", "last", "n", "words", "codes", "counts"]
BLOCK = "lang string, first array<binary>, last array<binary>, n bigint, words binary, codes binary, counts binary"
_KINDS = [pa.string(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def blocks(lang: str, levels: list[np.ndarray], counts: np.ndarray, words: pa.Array) -> Iterator[pa.RecordBatch]:
    """Sorted nodes in blocks, some at a time: first and last path, number of nodes, words in order, and each node's codes (0 for none, else from 1) and count.

    ``levels`` has the first words' numbers as they stand, and those of other words beside 1 for none.
    """
    rows = []
    for at in range(0, len(counts), NODES):
        part = [levels[0][at : at + NODES], *(x[at : at + NODES] - 1 for x in levels[1:])]
        used, codes = np.unique(np.concatenate(part), return_inverse=True)
        codes = codes.reshape(len(part), -1).astype(np.uint16)
        if used[0] >= 0:
            codes += 1
        names = words.take(pa.array(used[used >= 0])).to_pylist()
        path = lambda i: [names[c - 1] for c in codes[:, i] if c]  # noqa: E731, B023
        rows.append((lang, path(0), path(-1), codes.shape[1], b" ".join(names), codes.tobytes(), counts[at : at + NODES].astype(np.uint32).tobytes()))
        if len(rows) == 256 or at + NODES >= len(counts):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_BLOCK)
            rows = []


class Shard:
    """Collects words of texts and gives the windows of each lang among them, ``most`` words at a time."""

    def __init__(self, most: int) -> None:
        self.most, self.parts, self.langs, self.held = most, [], {}, 0

    def add(self, lang: str, words: list[bytes]) -> Iterator[Windows]:
        for at in range(0, len(words), self.most):
            part = words[at : at + self.most]
            self.parts.append((self.langs.setdefault(lang, len(self.langs)), pa.array(part, pa.binary())))
            self.held += len(part)
            while self.held >= self.most:
                yield from self.flush(2)

    def flush(self, keep: int = 0) -> Iterator[Windows]:
        """All windows that begin before the last ``keep`` words, which stay for the next shard."""
        if self.held <= keep:
            return
        words = pa.chunked_array([p for _, p in self.parts], pa.binary()).combine_chunks().dictionary_encode()
        lang = np.repeat(np.array([n for n, _ in self.parts]), [len(p) for _, p in self.parts])
        order = pc.array_sort_indices(words.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        codes, sorted_words = rank[words.indices.to_numpy()], words.dictionary.take(pa.array(order))
        stop = len(codes) - keep
        names = list(self.langs)
        rest = [(names[lang[i]], sorted_words[int(codes[i])].as_py()) for i in range(stop, len(codes))]
        self.parts, self.langs, self.held = [], {}, len(rest)
        for n, name in enumerate(names):
            yield Windows(name, codes, np.flatnonzero(lang[:stop] == n), sorted_words)
        self.parts = [(self.langs.setdefault(name, len(self.langs)), pa.array([w], pa.binary())) for name, w in rest]


def _windows(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[Windows]:
    """The windows of a worker's texts, shard by shard."""
    shard = Shard(words)
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for part in words_of(text):
                yield from shard.add(lang, part)
            yield from shard.add(lang, [_END])
    yield from shard.flush()


def tries(texts: DataFrame, frequent: np.ndarray | None = None, words: int = WORDS) -> DataFrame:
    """BLOCK rows of all shards: one and two words, and for each lang a row without nodes whose ``n`` is its number of words; with a map, three words."""
    sent = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _windows(batches, words):
            if sent.value is not None:
                yield from part.triples(sent.value)
                continue
            yield from part.pairs()
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((part.lang, None, None, len(part.at[0]), None, None, None), _KINDS, strict=True)], names=_BLOCK)

    return arrow_map(texts, run, BLOCK)


def _merged(lang: str, parts: list[tuple], least: int) -> pa.RecordBatch:
    """The nodes of one lang in a range of paths: sums over all blocks, from ``least`` on."""
    names = [w for p in parts for w in p[0].split(b" ")]
    words = pa.array(names, pa.binary()).dictionary_encode()
    order = pc.array_sort_indices(words.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    own = rank[words.indices.to_numpy()]
    levels, start = [], 0
    for spelled, codes, _ in parts:
        n = spelled.count(b" ") + 1
        table = np.concatenate([[0], own[start : start + n]])
        levels.append(table[np.frombuffer(codes, np.uint16)])
        start += n
    sizes = [len(c) // 4 for _, _, c in parts]
    depth = len(levels[0]) // sizes[0]
    columns = [np.concatenate([x[k * n : (k + 1) * n] for x, n in zip(levels, sizes, strict=True)]) for k in range(depth)]
    counts = np.concatenate([np.frombuffer(c, np.uint32) for _, _, c in parts]).astype(np.int64)
    width = len(order).bit_length()
    head, at = np.unique((columns[0] << width) | columns[1], return_inverse=True)
    path, sums = _counted(at if depth == 2 else (at << width) | columns[2], counts)
    first, third = (path, np.zeros(len(path), np.int64)) if depth == 2 else (path >> width, path & ((1 << width) - 1))
    codes = [head[first] >> width, head[first] & ((1 << width) - 1), third]
    sorted_words = words.dictionary.take(pa.array(order))

    at = np.flatnonzero(sums >= least)
    spelled = [sorted_words.take(pa.array(np.where(c[at] > 0, c[at] - 1, 0), mask=c[at] == 0)).cast(pa.string()) for c in codes]
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), *spelled, pa.array(sums[at])], names=_NAMES)


def _parted(lang: str, block: list[bytes], cuts: list[tuple]) -> Iterator[tuple]:
    """(range, words, codes, counts) of a block, a part for each range between the cuts that it has nodes of."""
    names, counts = block[0].split(b" "), np.frombuffer(block[2], np.uint32)
    n = len(counts)
    codes = np.frombuffer(block[1], np.uint16).reshape(-1, n)
    path = lambda i: (lang, *(names[c - 1] if c else b"" for c in codes[:, i]), *[b""] * (3 - len(codes)))
    first, last = bisect_right(cuts, path(0)), bisect_right(cuts, path(n - 1))
    if first == last:
        yield first, *block
        return
    at = 0
    for k in range(first, last + 1):
        stop = n if k == last else bisect_left(range(n), cuts[k], lo=at, key=path)
        if stop > at:
            used, own = np.unique(codes[:, at:stop], return_inverse=True)
            own = own.reshape(len(codes), -1) + (used[0] > 0)
            yield k, b" ".join(names[c - 1] for c in used if c), own.astype(np.uint16).tobytes(), counts[at:stop].tobytes()
        at = stop


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, 256 at a time: they are large."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield batch.slice(at, 256)


def merged(tries_: DataFrame, least: int, nodes: int = RANGE) -> DataFrame:
    """NODE rows that occur ``least`` times: the written blocks of all tries, merged by prefix ranges of about so many nodes."""
    whole = tries_.filter("words is not null")
    total, rows = whole.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ranges = max(1, -(-total // nodes))
    share = min(1.0, LOOKED_AT * ranges / max(1, rows))
    key = lambda lang, path: (lang, *(bytes(w) for w in path), *[b""] * (3 - len(path)))
    seen = sorted(key(*r) for r in whole.select("lang", "first").sample(share, seed=1).collect()) if ranges > 1 else []
    cuts = sorted({seen[k * len(seen) // ranges] for k in range(1, ranges)}) if seen else []
    sent = tries_.sparkSession.sparkContext.broadcast(cuts)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every node to its range: a block that spans several is parted."""
        for batch in _few(batches):
            rows = [(r, lang, *part) for lang, *block in zip(*(batch.column(i).to_pylist() for i in (0, 4, 5, 6)), strict=True) for r, *part in _parted(lang, block, sent.value)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), *(_KINDS[i] for i in (0, 4, 5, 6))), strict=True)], names=["range", "lang", "words", "codes", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        for batch in _few(batches):
            for k, lang, *block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k, lang) != now:
                    if parts:
                        yield _merged(now[1], parts, least)
                    now, parts = (k, lang), []
                parts.append(tuple(block))
        if parts:
            yield _merged(now[1], parts, least)

    sent_on = whole.mapInArrow(dealt, "range bigint, lang string, words binary, codes binary, counts binary")
    return sent_on.repartition(F.col("range")).sortWithinPartitions("range", "lang").mapInArrow(run, NODE)


def frequent_pairs(nodes: DataFrame, bits: int = BITS) -> np.ndarray:
    """The bitmap of the pairs among frequent nodes; at most ``bits`` / 64 numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = _hashes(batch.column(1).cast(pa.binary())), _hashes(batch.column(2).cast(pa.binary()))
            langs = batch.column(0).dictionary_encode()
            at, codes = np.zeros(batch.num_rows, np.uint64), langs.indices.to_numpy()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                mine = codes == k
                at[mine] = pair_bits(lang, first[mine], second[mine], bits)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64))], names=["at"])

    at = nodes.filter("w2 is not null and w3 is null").mapInArrow(run, "at bigint")
    longs = at.groupBy(F.shiftright("at", 6).alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[longs.column("k").to_numpy()] = longs.column("bits").to_numpy()
    return out.view(np.uint8)


def walked(nodes: DataFrame) -> DataFrame:
    """NODE with ``l1`` and ``l2``, the counts of the first word and of the first two, from a walk in trie order.

    ``l1`` is null where the first word's node is in an earlier range, which one first word of each range can be.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = two = None
        for batch in batches:
            l1, l2 = [], []
            for lang, a, b, c, f in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if b is None:
                    one, two = (lang, a, f), None
                elif c is None:
                    two = (a, b, f)
                    one = one if one and one[:2] == (lang, a) else None
                l1.append(one[2] if one and one[:2] == (lang, a) else None)
                l2.append(two[2] if c is not None and two and two[:2] == (a, b) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(l1, pa.int64()), pa.array(l2, pa.int64())], names=[*_NAMES, "l1", "l2"])

    prefix = ["lang", "w1", "w2"]
    return nodes.repartitionByRange(*prefix).sortWithinPartitions(*prefix, "w3").mapInArrow(run, NODE + ", l1 bigint, l2 bigint")


def _score(a: str, left: str, right: str) -> str:
    d = "cast({} as decimal(20, 0))".format
    return f"(cast(1000000 as decimal(7, 0)) * cast({d(a)} * {d(a)} as decimal(31, 0))) div ({d(left)} * {d(right)})"


def collocations(docs: DataFrame, least: int = 10, covered: int = 50, top: int = 2000, words: int = WORDS, bits: int = BITS, nodes: int = RANGE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of two or three words of each lang.

    Candidates occur at least ``least`` times; one goes if a longer candidate that holds it has at least ``covered`` percent of its occurrences.
    ``words`` (at most 2,000,000) bounds a shard, ``bits`` (a multiple of 64) the map of pairs, ``nodes`` a range; none changes the result.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    first = written(tries(texts, words=words), "tries")
    short = written(merged(first, least, nodes), "nodes")
    second = written(tries(texts, frequent_pairs(short, bits), words), "tries")
    long = written(merged(second, least, nodes), "nodes")
    sums = first.filter("words is null").groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = short.union(long)
    walk = written(walked(frequent), "walked")
    ones = walk.filter("w2 is null").select("lang", F.col("w1").alias("w"), F.col("f").alias("g"))
    pairs = short.filter("w2 is not null")
    # a range's first word whose node is in an earlier range
    open_ = written(walk.filter("w2 is not null and l1 is null").select("lang", F.col("w1").alias("w")).distinct(), "open")
    known = written(open_.join(ones, ["lang", "w"]).select(F.col("lang").alias("lang_"), "w", "g"), "open")
    parts = walk.filter("w2 is not null").join(bounded(known, SMALL), (F.col("lang") == F.col("lang_")) & (F.col("w1") == F.col("w")) & F.col("l1").isNull(), "left").withColumn("l1", F.coalesce("l1", "g")).drop("lang_", "w", "g")
    # suffix links: the path without its first word, and without its first two
    links = walk.filter("w1 is not null and w3 is null").select(F.col("lang").alias("lang_"), F.col("w1").alias("s1"), F.coalesce("w2", F.lit("")).alias("s2"), F.col("f").alias("r1"))
    joined = parts.join(links, (F.col("lang") == F.col("lang_")) & (F.col("w2") == F.col("s1")) & (F.coalesce("w3", F.lit("")) == F.col("s2"))).drop("lang_", "s1", "s2")
    last = ones.select(F.col("lang").alias("lang_"), "w", F.col("g").alias("r2"))
    twos = joined.filter("w3 is null").withColumn("r2", F.lit(None).cast("bigint"))
    threes = joined.filter("w3 is not null").join(last, (F.col("lang") == F.col("lang_")) & (F.col("w3") == F.col("w"))).drop("lang_", "w")
    # pairs that a longer candidate covers
    within = long.select("lang", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"), "f").groupBy("lang", "p").agg(F.max("f").alias("over"))
    gone = pairs.join(within.select(F.col("lang").alias("lang_"), F.col("p.w1").alias("g1"), F.col("p.w2").alias("g2"), "over"), (F.col("lang") == F.col("lang_")) & (F.col("w1") == F.col("g1")) & (F.col("w2") == F.col("g2"))).filter(100 * F.col("over") >= covered * F.col("f")).select("lang", "w1", "w2")
    found = twos.join(gone, ["lang", "w1", "w2"], "left_anti").unionByName(threes)
    scored = found.withColumn("x", F.expr(_score("f", "l1", "r1"))).withColumn("y", F.when(F.col("w3").isNotNull(), F.expr(_score("f", "l2", "r2"))))
    second = F.coalesce(F.col("y") < F.col("x"), F.lit(False))
    pick = lambda p, q: F.when(second, F.col(q)).otherwise(F.col(p))
    rows = scored.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("f").alias("a"), pick("l1", "l2").alias("l"), pick("r1", "r2").alias("r"), pick("x", "y").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(sums, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("bigint").alias("score"))
