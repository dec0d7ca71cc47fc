"""Line dedup: an exact set-similarity join of lines, DataFrame functions only.

A line's tokens are its different words. Tokens are ordered by rarity: their hashes fall into 65,536
buckets, the buckets are graded by how often their words occur in the whole corpus (thirds of a power of two), and a token
becomes one long of its bucket's grade above the rest of its hash, so that sorting longs sorts by rarity. Lines
with equal token sets are copies of the first of them, and only that one is compared further.

Two sets with Jaccard similarity of at least 0.8 share a token of their prefixes of n - ceil(0.8 n) + 1
rarest tokens. Prefixes are posted by token; pairs that meet pass the length filter, the positional
filter and a filter on parity maps before their whole sets are compared. A parity map has one bit
for each class of tokens, set if the set has an odd number of them, so the bits in which two maps differ
are at most the tokens that only one set has, however long the sets are.

Near copies would meet in all pairs. So before the join, sets in postings longer than HOT are held against PIVOTS
early sets of the posting, and a set that is verified to resemble one of them is settled. In the join, the
later side of a pair isn't settled, so the pairs made stay in proportion to the lines. Postings are joined in
RANGES ranges of tokens, one after the other, which bounds the shuffle files; a long posting is one
key of a plain join, which Spark splits where it is skewed.

A line goes if an equal or similar line stands earlier, in the order of doc_id (null last),
place and hash of the text. Lines without words stay. Tokens are told apart by 64-bit hashes (grade and 56 bits), and
equal sets by a hash of all tokens, their number and their parity maps.

Cases: null texts stay null; a text whose lines all go becomes empty; sets of up to three tokens match equal
sets only; equal texts under one doc_id (null too) are one document, so repeated rows keep the same lines; different texts under one doc_id
are told apart by a 64-bit hash;
an empty table gives no rows; all other columns, whatever their names, pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.llm.common import BLANKS, ROW, wrapped, written
from colophon.operators.tables import bounded, forget, release

BUCKETS = 1 << 16
#: Postings, of HEAD tokens of each prefix, with more sets than HOT are first held against PIVOTS early sets.
HOT, PIVOTS, HEAD = 128, 32, 3
#: Ranges of tokens that are joined one after the other.
RANGES = 2
#: Sets of more tokens have parity maps of 128 bits, others of 64.
LONG = 40
#: Rows up to which a counted side may be broadcast (its bytes are bounded as well); beyond, both sides are shuffled.
SMALL = 1_000_000
_LAST = (1 << 63) - 1

#: What tells the lines apart.
LINE, LINE2 = ["doc", "text_hash", "pos"], ["doc2", "text_hash2", "pos2"]
#: What tells the sets apart.
SET = ["sid", "map_a", "map_b"]


def _plain(text: Column) -> Column:
    """The text with words one space apart, up to a space at the ends of lines; most texts are so already."""
    odd = F.lit(False)
    for c in ("  ", *(c for c in BLANKS if c not in " \n")):
        odd = odd | F.contains(text, F.lit(c))
    return F.when(odd, F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(text)


def rarity(docs: DataFrame) -> list[int]:
    """Grade of each hash bucket by how often its words occur in all documents: 0 to 127, the rarest first."""
    words = docs.select(F.explode(F.split(F.replace(_plain(F.col("text")), F.lit("\n"), F.lit(" ")), " ")).alias("w")).filter("w <> ''")
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")).count().collect()
    grades = [0] * BUCKETS
    for row in counts:
        grades[row["bucket"]] = min(127, int(3 * math.log2(row["count"] + 1)))
    return grades


def _tokens(line: Column, grades: list[int]) -> Column:
    """The line's different tokens, the rarest first."""
    table = F.split(F.lit(",".join(map(str, grades))), ",").cast("array<tinyint>")
    nothing = F.lit(0).cast("bigint")

    def token(h: Column) -> Column:
        grade = F.coalesce(F.get(table, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")).cast("bigint"), nothing)
        return F.shiftleft(grade, 56).bitwiseOR(F.shiftrightunsigned(h, 8))

    return F.sort_array(F.transform(F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w))), token))


def _parity(tokens: Column, half: int | None = None) -> Column:
    """64 bits by the lowest six bits of each token: of all tokens, or of those whose next bit is ``half``."""
    one = F.lit(1).cast("bigint")
    bit = lambda t: one if half is None else F.shiftright(t, 6).bitwiseXOR(F.lit(1 - half)).bitwiseAND(one)
    return F.aggregate(tokens, F.lit(0).cast("bigint"), lambda acc, t: acc.bitwiseXOR(F.call_function("shiftleft", bit(t), t.bitwiseAND(F.lit(63)).cast("int"))))


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST))


def _each_line(docs: DataFrame) -> DataFrame:
    """(doc, text_hash, pos, line) of lines with words, one space apart; doc orders null ids last."""
    return docs.select(_doc().alias("doc"), F.xxhash64("text").alias("text_hash"), F.posexplode(F.split(_plain(F.col("text")), "\n", -1)).alias("pos", "line")).withColumn("line", F.btrim("line", F.lit(" "))).filter("line <> ''")


def _lines(docs: DataFrame, grades: list[int]) -> DataFrame:
    tokens = _each_line(docs).withColumn("tokens", _tokens(F.col("line"), grades)).drop("line")
    n, none = F.size("tokens"), F.lit(0).cast("bigint")
    map_a = F.when(n < 4, none).when(n <= LONG, _parity(F.col("tokens"))).otherwise(_parity(F.col("tokens"), 0))
    map_b = F.when(n <= LONG, none).otherwise(_parity(F.col("tokens"), 1))
    rarest = F.slice("tokens", F.lit(1), n - F.ceil(n * 4 / 5).cast("int") + 1)
    prefix = F.when(n >= 4, rarest).otherwise(F.array().cast("array<bigint>"))
    return tokens.select(*LINE, F.xxhash64("tokens").alias("sid"), n.alias("n"), map_a.alias("map_a"), map_b.alias("map_b"), prefix.alias("prefix"))


def _before(b: str, a: str, names: list[str]) -> Column:
    """Does b stand before a in the order of ``names``?"""
    at = lambda side, name: F.col(f"{side}.{name}")
    same, out = F.lit(True), F.lit(False)
    for name in names:
        out = out | (same & (at(b, name) < at(a, name)))
        same = same & (at(b, name) == at(a, name))
    return out


def _earlier(b: str, a: str) -> Column:
    return _before(b, a, ["doc", "pos", "text_hash"])


def _differ(a: str, b: str) -> Column:
    """A lower bound of the number of tokens that only one side has."""
    at = lambda side, name: F.col(f"{side}.{name}")
    halves = F.bit_count(at(a, "map_a").bitwiseXOR(at(b, "map_a"))) + F.bit_count(at(a, "map_b").bitwiseXOR(at(b, "map_b")))
    # the two halves of a long map give the short one
    folded = F.bit_count(at(a, "map_a").bitwiseXOR(at(a, "map_b")).bitwiseXOR(at(b, "map_a")).bitwiseXOR(at(b, "map_b")))
    return F.when((at(a, "n") > LONG) & (at(b, "n") > LONG), halves).otherwise(folded)


def _near(a: str, b: str) -> Column:
    """The length and parity filters, implied by a Jaccard similarity of at least 0.8."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    needed = F.expr(f"(({a}.n + {b}.n) * 4 + 8) div 9")
    return (na * 5 >= nb * 4) & (nb * 5 >= na * 4) & (_differ(a, b) <= na + nb - needed * 2)


def _in_place(a: str, b: str) -> Column:
    """The positional filter on the first token that two similar sets share."""
    at = lambda side, name: F.col(f"{side}.{name}")
    na, nb, i, j = at(a, "n"), at(b, "n"), at(a, "at"), at(b, "at")
    needed = F.expr(f"(({a}.n + {b}.n) * 4 + 8) div 9")
    positional = F.least(i, j) + F.least(na - i, nb - j) >= needed
    # the shorter set shares a token among its first n - ceil(8 n / 9) + 1
    shorter = F.when(na < nb, i * 9 <= na).when(na > nb, j * 9 <= nb).otherwise((i * 9 <= na) & (j * 9 <= nb))
    return shorter & positional


def _bounded(df: DataFrame) -> DataFrame:
    return bounded(df, SMALL)


def _verified(pairs: DataFrame, docs: DataFrame, grades: list[int]) -> DataFrame:
    """LINE of the later lines among the written ``pairs`` of LINE and LINE2 whose whole sets are similar."""
    wanted = written(pairs.select(*LINE).union(pairs.select(*LINE2)).distinct(), "wanted")
    owners = written(wanted.select("doc").distinct(), "owners")
    few = docs.select("doc_id", "text").join(_bounded(owners), _doc() == F.col("doc"), "left_semi")
    sets = written(_each_line(few).join(_bounded(wanted), LINE, "left_semi").dropDuplicates(LINE).select(*LINE, _tokens(F.col("line"), grades).alias("tokens")), "sets")
    both = pairs.join(sets, LINE).join(sets.select(*(F.col(c).alias(f"{c}2") for c in LINE), F.col("tokens").alias("tokens2")), LINE2)
    alike = F.size(F.array_intersect("tokens", "tokens2")) * 9 >= (F.size("tokens") + F.size("tokens2")) * 4
    out = written(both.filter(alike).select(*LINE).distinct(), "verified")
    for used in (wanted, owners, sets):
        forget(used)
    return out


def _settled(sets: DataFrame, docs: DataFrame, grades: list[int]) -> DataFrame | None:
    """LINE of sets in long postings that resemble an early set there; None without such postings."""
    # the tokens of the least hashes, which most copies have in common; the rarest would be the words that differ
    scattered = F.sort_array(F.transform("prefix", lambda t: F.shiftleft(t, 8)))
    head = sets.select(*SET, *LINE, "n", F.explode(F.slice(scattered, F.lit(1), F.lit(HEAD))).alias("token"))
    long_ = written(head.groupBy("token").count().filter(F.col("count") > HOT).select("token"), "long")
    many = written(head.join(_bounded(long_), "token", "left_semi"), "many")
    forget(long_)
    if not many.limit(1).count():
        forget(many)
        return None
    early = many.groupBy("token", F.pmod("sid", F.lit(PIVOTS)).alias("side")).agg(F.min(F.struct("doc", "pos", "text_hash", "n", "map_a", "map_b")).alias("b")).select("token", "b.*")
    pivots = written(early, "pivots")
    a, b = many.alias("a"), pivots.alias("b")
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & _near("a", "b") & _earlier("b", "a"))
    partner = F.min(F.struct(_differ("a", "b").alias("differ"), *(F.col(f"b.{c}").alias(f"{c}2") for c in LINE))).alias("b")
    pairs = written(met.groupBy(*(F.col(f"a.{c}").alias(c) for c in LINE)).agg(partner).select(*LINE, *(f"b.{c}" for c in LINE2)), "likeliest")
    forget(many)
    forget(pivots)
    out = _verified(pairs, docs, grades)
    forget(pairs)
    return out


def _candidates(sets: DataFrame, settled: DataFrame | None) -> DataFrame:
    """(SET, SET2) of different sets that meet in a prefix and pass the filters, and whose later one isn't settled."""
    if settled is None:
        open_ = sets.withColumn("done", F.lit(0))
    else:
        open_ = sets.join(_bounded(settled.withColumn("done", F.lit(1))), LINE, "left").withColumn("done", F.coalesce("done", F.lit(0)))
    # number of tokens, place in the prefix and settledness in one long
    pack = F.shiftleft(F.col("n").cast("bigint"), 32).bitwiseOR(F.shiftleft("at", 1).bitwiseOR(F.col("done")).cast("bigint"))
    posts = open_.select(*SET, "doc", "n", "done", F.posexplode("prefix").alias("at", "token")).select("token", *SET, "doc", pack.alias("pack"))
    unpack = [F.shiftright("pack", 32).cast("int").alias("n"), F.shiftright(F.col("pack").bitwiseAND(F.lit((1 << 32) - 1)), 1).cast("int").alias("at"), F.col("pack").bitwiseAND(F.lit(1)).alias("done")]
    found: list[DataFrame] = []
    for k in range(RANGES):
        part = posts.filter(F.pmod("token", F.lit(RANGES)) == k)
        # both sides are one exchange; what differs between them is in the join's condition
        a, b = (part.select("token", *SET, "doc", *unpack).alias(side) for side in "ab")
        done = lambda side: F.col(f"{side}.done") == 1
        # within a document either may be the later one
        open_later = ~((done("a") & (F.col("a.doc") > F.col("b.doc"))) | (done("b") & (F.col("b.doc") > F.col("a.doc"))) | (done("a") & done("b")))
        met = a.join(b, (F.col("a.token") == F.col("b.token")) & _before("a", "b", SET[:2]) & open_later & _near("a", "b") & _in_place("a", "b"))
        found.append(written(met.select(*(F.col(f"a.{c}").alias(c) for c in SET), *(F.col(f"b.{c}").alias(f"{c}2") for c in SET)).distinct(), "met"))
        del part, a, b, met
        release(sets.sparkSession)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    pairs = written(out.distinct(), "pairs")
    for used in found:
        forget(used)
    return pairs


def _matched(sets: DataFrame, docs: DataFrame, grades: list[int]) -> DataFrame:
    """LINE of those of the different sets that a similar set precedes."""
    settled = _settled(sets, docs, grades)
    pairs = _candidates(sets, settled)
    second = [f"{c}2" for c in SET]
    ids = written(pairs.select(*SET).union(pairs.select(*second)).distinct(), "ids")
    ends = written(sets.join(_bounded(ids), SET).select(*SET, *LINE), "ends")
    a, b = ends.alias("a"), ends.select(*(F.col(c).alias(f"{c}2") for c in SET + LINE)).alias("b")
    placed = pairs.join(_bounded(a), SET).join(_bounded(b), second)
    swap = F.lit(False)
    same = F.lit(True)
    for c in ("doc", "pos", "text_hash"):
        swap = swap | (same & (F.col(c) < F.col(f"{c}2")))
        same = same & (F.col(c) == F.col(f"{c}2"))
    ordered = placed.select(*(F.when(swap, F.col(f"{c}2")).otherwise(F.col(c)).alias(c) for c in LINE), *(F.when(swap, F.col(c)).otherwise(F.col(f"{c}2")).alias(f"{c}2") for c in LINE))
    if settled is not None:
        ordered = ordered.join(_bounded(settled), LINE, "left_anti")
    wanted = written(ordered, "ordered")
    for used in (pairs, ids, ends):
        forget(used)
    found = _verified(wanted, docs, grades)
    forget(wanted)
    if settled is None:
        return found
    out = written(settled.union(found), "matched")
    forget(settled)
    forget(found)
    return out


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc, text_hash, gone) with the places of all lines that go, for texts that lose any."""
    grades = rarity(docs)
    lines = written(_lines(docs, grades), "lines")
    # the first place of each set that has several, in one number, so that the aggregate works in place:
    # doc, pos and the upper 31 bits of the text's hash, in the order of _earlier
    within = F.shiftleft(F.col("pos").cast("bigint"), 31) + F.shiftright("text_hash", 33) + F.lit(1 << 30)
    place = (F.col("doc").cast("decimal(38,0)") * F.lit(1 << 62).cast("decimal(38,0)") + within).cast("decimal(38,0)")
    alike = ["sid", "n", "map_a", "map_b"]
    keys = lines.select(*alike, place.alias("place"))
    several = written(keys.groupBy(*alike).agg(F.min("place").alias("first"), F.count("*").alias("copies")).filter("copies > 1").drop("copies"), "several")
    marked = lines.withColumn("place", place).join(_bounded(several), alike, "left")
    again = written(marked.filter("place > first").select(*LINE), "again")
    sets = written(marked.filter("n >= 4 and (first is null or place = first)").select(*LINE, *SET, "n", "prefix"), "sets")
    forget(lines)
    forget(several)
    release(docs.sparkSession)
    matched = _matched(sets, docs, grades)
    forget(sets)
    gone = written(again.union(matched).groupBy("doc", "text_hash").agg(F.collect_set("pos").alias("gone")), "gone")
    forget(again)
    forget(matched)
    release(docs.sparkSession)
    return gone


def _kept(text: Column, gone: Column) -> Column:
    """The text without the lines whose places are in ``gone``."""
    lines = F.split(text, "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), _count(text) - 1), gone)
    # bound in an array of one, so that the text is split once
    both = F.array(F.struct(lines.alias("lines"), left.alias("left")))
    joined = F.get(F.transform(both, lambda x: F.array_join(F.transform(x["left"], lambda i: F.get(x["lines"], i)), "\n")), F.lit(0))
    return F.when(gone.isNull(), text).otherwise(joined)


def _count(text: Column) -> Column:
    """How many lines the text has."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents with all columns, and in ``text`` only the lines that stay."""
    gone = removed_lines(docs)
    keyed = wrapped(docs, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("text_hash"))
    joined = keyed.join(_bounded(gone), ["doc", "text_hash"], "left")
    return joined.select(F.col(ROW).withField("text", _kept(F.col(f"{ROW}.text"), F.col("gone"))).alias(ROW)).select(f"{ROW}.*")


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, the text that is left, and how many lines there were and how many went."""
    gone = removed_lines(docs)
    few = docs.select("doc_id", "text", _doc().alias("doc"), F.xxhash64("text").alias("text_hash"))
    joined = few.join(_bounded(gone), ["doc", "text_hash"], "left")
    n = F.coalesce(_count(F.col("text")), F.lit(0)).cast("bigint")
    return joined.select("doc_id", _kept(F.col("text"), F.col("gone")).alias("text"), n.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"))
