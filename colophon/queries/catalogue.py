"""Catalogue queries over small literal libraries, held against stated results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.operators import blocking
from colophon.operators.verdict import IDENTITY, by_cover, decide, verdict, with_publishers
from colophon.plans import execute, ladder, review, selection
from colophon.plans.features import BOOKS
from colophon.queries import literal, query, read, spread, stated, values_sql

TA = ["Tove Almqvist"]


def book(lib: str, side: str, key: int, title: str = "Tides", authors: list[str] = TA, **more: object) -> dict:
    row = {"publisher": None, "year": None, "isbns": [], "asins": [], "series": None, "series_number": None, "tags": [], "languages": [], "formats": ["EPUB"], "has_cover": False, "comments": None, "text_id": None, "digest": None, "ai_year": None, "ai_publisher": None, "ai_edition": None, "file_title": None, "text_lang": None, "text_chars": None, "cover": None, "page_cover": None, "broken": [], "foreign": []}
    return {"lib": lib, "side": side, "id": key, "title": title, "authors": authors, **row, **more}


S, T = "source", "target"
ISBN, ISBN2 = "9780306406157", "9780804429573"
#: Cases of two libraries, by name; what is expected of their source records stands beside them.
TWO = [
    (book("c01", S, 1, publisher="Osprey", year=1990), "trash", 1), (book("c01", T, 1, publisher="Osprey Books", year=1990, formats=["PDF"]), None, None),
    (book("c02", S, 1, "Tides Return"), "move", None),
    (book("c03", S, 1, "Children of the Tides"), "leave", 1), (book("c03", T, 1, "Children of the Tides", publisher="Osprey", year=1991), None, None),
    (book("c04", S, 1, "Unknown", ["Unknown"]), "leave", None),
    (book("c05", S, 1, isbns=["0-306-40615-2"], formats=["PDF", "MOBI"]), "trash", 1), (book("c05", T, 1, isbns=[ISBN]), None, None),
    (book("c06", S, 1, isbns=[ISBN]), "move", None), (book("c06", S, 2, isbns=[ISBN]), "trash", 1),
    (book("c07", S, 1, "Tides (2nd Edition)", publisher="Osprey"), "leave", 1), (book("c07", T, 1, publisher="Osprey", year=1965), None, None),
    (book("c11", S, 1, authors=["Tove Almqvist", "Karl Almqvist"], isbns=[ISBN]), "move", None), (book("c11", T, 1, isbns=[ISBN]), None, None),
    (book("c12", S, 1, asins=["b01blyjwma"]), "trash", 1), (book("c12", T, 1, asins=["B01BLYJWMA"]), None, None),
    (book("c13", S, 1, asins=["F20"]), "leave", 1), (book("c13", T, 1, asins=["F20"]), None, None),
    (book("c14", S, 1, text_id=1), "trash", 1), (book("c14", T, 1, publisher="Osprey", text_id=2), None, None),
    (book("c26", S, 1, "One", ["A Aa"], digest="x", formats=["PDF"]), "move", None), (book("c26", T, 2, "Two", ["B Bb"], digest="x", formats=["PDF"]), None, None), (book("c26", T, 3, "Three", ["C Cc"], digest="x", formats=["PDF"]), None, None),
    (book("c33", S, 1, "Harbour 0077 - Lindqvist", ["Lindqvist"], isbns=[ISBN]), "leave", None), (book("c33", T, 1, "Glass Island", ["Lindqvist"], isbns=[ISBN]), None, None),
    (book("c36", S, 1, "Saga 1", isbns=[ISBN]), "move", None), (book("c36", T, 1, "Saga 2", isbns=[ISBN]), None, None),
    (book("c37", S, 1, "Saga 1", digest="y"), "trash", 1), (book("c37", T, 1, "Saga 2", digest="y"), None, None),
    (book("c39", S, 1, isbns=[ISBN]), "leave", 1), (book("c39", T, 1, publisher="Osprey", isbns=[ISBN]), None, None), (book("c39", T, 2, "Two", ["B Bb"], isbns=[ISBN]), None, None), (book("c39", T, 3, "Three", ["C Cc"], isbns=[ISBN]), None, None),
    (book("c40", S, 1, formats=[]), "trash", None), (book("c40", S, 2), "move", None), (book("c40", T, 1, formats=[]), None, None),
    (book("c41", S, 1, publisher="Osprey", text_id=3), "trash", 1), (book("c41", T, 1, publisher="Kestrel", text_id=4), None, None),
    (book("c42", S, 1, publisher="Osprey"), "move", 1), (book("c42", T, 1, publisher="Kestrel"), None, None),
]
ONE = [
    (book("c08", S, 1, publisher="Osprey", year=1990), "leave", None), (book("c08", S, 2, publisher="Osprey", year=1990, formats=["MOBI"], has_cover=True, comments="rich"), "trash", 1),
    (book("c09", S, 1, publisher="Osprey", year=1990, formats=["AZW3"], has_cover=True, comments="rich"), "trash", 2), (book("c09", S, 2, publisher="Osprey", year=1990, formats=["MOBI"]), "leave", None),
    (book("c09b", S, 1, publisher="Osprey", year=1990), "trash", 2), (book("c09b", S, 2, publisher="Osprey", year=1990, comments="rich"), "leave", None),
    (book("c10", S, 1, publisher="Osprey", year=1965), "leave", None), (book("c10", S, 2, publisher="Osprey", year=1990), "leave", 1),
]
OPTIONAL = [
    (book("c15", S, 1, "Sailing", ["Eva Holm"], series="Bluebird", series_number=118.0), "trash", 1), (book("c15", T, 1, "Sailing the Gulf", ["Eva Holm"], series="Bluebird", series_number=118.0), None, None),
    (book("c17", S, 1, series="Bluebird", series_number=1.0, isbns=[ISBN]), "trash", 1), (book("c17", T, 1, series="Bluebird", series_number=1.0, isbns=[ISBN]), None, None),
    (book("c18", S, 1, "4 Silver Harbour", ["Harriet Oakes"]), "leave", 1), (book("c18", T, 1, "Silver Harbour", ["Harriet Oakes"]), None, None),
    (book("c19", S, 1, "Tides Return"), "move", None), (book("c19", T, 1), None, None),
    (book("c20", S, 1, "4 Silver Harbour", ["Harriet Oakes"], publisher="Osprey"), "move", 1), (book("c20", T, 1, "Silver Harbour", ["Harriet Oakes"], publisher="Kestrel"), None, None),
    (book("c21", S, 1, "Canvas Roads", ["Margarret Oakes"], text_id=1), "trash", 1), (book("c21", T, 1, "Canvas Roads", ["Oakes, Margaret"], text_id=2), None, None),
    (book("c22", S, 1, "Quarry", ["Peter Oakes"]), "move", None), (book("c22", T, 1, "Quarry", ["Simon Oakes"]), None, None),
    (book("c11s", S, 1, authors=["Tove Almqvist", "Karl Almqvist"], isbns=[ISBN]), "trash", 1), (book("c11s", T, 1, isbns=[ISBN]), None, None),
]


def _libs(cases: list) -> list[str]:
    return sorted({c[0]["lib"] for c in cases})


def _over_parts(spark: SparkSession, sf_dir: str, df: DataFrame, libs: list[str]) -> DataFrame:
    """Each part gets the libraries of one case, named by the case and the part's key; the key is added as ``part``."""
    numbers = F.create_map(*(x for k, lib in enumerate(libs) for x in (F.lit(lib), F.lit(k))))
    parts = spread(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), (F.col("p_partkey") % len(libs)).cast("int").alias("case"))
    dealt = parts.join(F.broadcast(df.withColumn("case", F.element_at(numbers, F.col("lib")))), "case").drop("case")
    return dealt.withColumn("lib", F.concat("lib", F.lit("-"), F.col("part").cast("string")))


def _books(spark: SparkSession, sf_dir: str, cases: list) -> DataFrame:
    """The cases dealt to all parts; files and texts are each part's own."""
    names = [f.split()[0] for f in BOOKS.split(", ")]
    stated_ = spark.createDataFrame([tuple(c[0][n] for n in names) for c in cases], BOOKS)
    dealt = _over_parts(spark, sf_dir, stated_, _libs(cases))
    own = F.concat("digest", F.lit("-"), F.col("part").cast("string"))
    return dealt.withColumn("digest", own).withColumn("text_id", F.col("text_id") + F.col("part") * 10).select(*names)


def _dealt(rows: list[tuple], names: str, libs: list[str], casts: str = "") -> str:
    """SQL of rows that begin with a case, for all parts with that case."""
    body = ", ".join("(" + ", ".join([str(libs.index(r[0])), *map(literal, r)]) + ")" for r in rows)
    own = names.split(", ")
    return f"SELECT c.lib || '-' || p_partkey AS lib, {', '.join(f'c.{n} AS {n}' for n in own[1:])} FROM part JOIN (VALUES {body}) c(k, {names}) ON p_partkey % {len(libs)} = k"


def _expected(cases: list) -> str:
    return _dealt([(b["lib"], b["id"], action, match) for b, action, match in cases if action], "lib, id, action, match", _libs(cases))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What texts of each part's books share."""
    shares = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(s).alias("share")) for a, b, s in ((1, 2, 1.0), (3, 4, 0.97), (1, 3, 0.1))))
    own = spread(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.explode(shares).alias("s"))
    return own.select((F.col("s.a") + F.col("part") * 10).alias("a"), (F.col("s.b") + F.col("part") * 10).alias("b"), "s.share")


@query(_expected(TWO))
def dedup_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DL0, DL2-DL8, DL11c, of DL13 the file-name hold, AG2, AG3, SQ1 over two libraries."""
    return ladder.plan(_books(spark, sf_dir, TWO), texts=_texts(spark, sf_dir)).select("lib", "id", "action", "match")


@query(_expected(ONE))
def dedup_plan_one_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN1, JN14, SQ1 within one library."""
    return ladder.plan(_books(spark, sf_dir, ONE), ladder.Options(one_library=True)).select("lib", "id", "action", "match")


@query(_expected(OPTIONAL))
def dedup_plan_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DL3, DL5, DL12, JN2, JN3, JN5, JN6 with their options on."""
    options = ladder.Options(similar_authors=True, same_series=True, similar_titles=True, author_variants=True)
    return ladder.plan(_books(spark, sf_dir, OPTIONAL), options, _texts(spark, sf_dir)).select("lib", "id", "action", "match")


@query(_dealt([(b["lib"], b["id"], "leave" if a == "move" or b["lib"] in ("c01", "c05") else a) for b, a, _ in TWO if a], "lib, id, action", _libs(TWO)))
def cleanup_only_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DL14: c01 and c05 stay, since the target's copies lack a format of theirs."""
    books = _books(spark, sf_dir, TWO)
    return ladder.cleanup_only(ladder.plan(books, texts=_texts(spark, sf_dir)), books).select("lib", "id", "action")


CLEANUP = [
    (book("c23a", S, 1, isbns=[ISBN]), "trash", 1), (book("c23a", T, 1, isbns=[ISBN]), None, None),
    (book("c23b", S, 1, isbns=[ISBN], comments="rich"), "leave", None), (book("c23b", S, 2, isbns=[ISBN]), "trash", 1),
    (book("c23c", S, 1, isbns=[ISBN], formats=["EPUB", "MOBI"]), "leave", 1), (book("c23c", T, 1, isbns=[ISBN]), None, None),
]


@query(_expected(CLEANUP))
def cleanup_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DL14: copies of what stays go into it."""
    books = _books(spark, sf_dir, CLEANUP)
    return ladder.cleanup_only(ladder.plan(books), books).select("lib", "id", "action", "match")


FACTS = [
    # swapped title and author: put right for matching, never moved; a biography isn't swapped
    (book("c24", S, 1, "Lindqvist", ["The Inn at the End of a Road"], text_id=1), "trash", 1, "same text"), (book("c24", T, 1, "The Inn at the End of a Road", ["Lindqvist"], text_id=2), None, None, None), (book("c24", T, 2, "Salt Roads", ["Lindqvist"]), None, None, None),
    (book("c24b", S, 1, "Lindqvist", ["A Lamp in Winter"]), "leave", None, "held: swapped"), (book("c24b", T, 2, "Salt Roads", ["Lindqvist"]), None, None, None),
    (book("c25", S, 1, "Delacroix", ["Peter Oakes"]), "move", None, "nothing like it"), (book("c25", T, 1, "Canvas", ["Delacroix"]), None, None, None), (book("c25", T, 2, "Tides", ["Peter Oakes"]), None, None, None),
    # another language is another book
    (book("c27", S, 1, isbns=[ISBN], text_lang="ita"), "move", 1, "different"), (book("c27", T, 1, isbns=[ISBN], text_lang="eng"), None, None, None),
    (book("c28", S, 1, isbns=[ISBN], text_lang="ita"), "trash", 2, "isbn"), (book("c28", T, 1, isbns=[ISBN], text_lang="eng"), None, None, None), (book("c28", T, 2, isbns=[ISBN], text_lang="ita"), None, None, None),
    # covers, with no edition data on one side
    (book("c29a", S, 1, cover="u"), "trash", 1, "nothing tells them apart"), (book("c29a", T, 1, publisher="Osprey", cover="v"), None, None, None),
    (book("c29b", S, 1, cover="s"), "trash", 1, "same cover"), (book("c29b", T, 1, publisher="Osprey", cover="s2"), None, None, None),
    (book("c29c", S, 1, cover="d"), "leave", 1, "to check"), (book("c29c", T, 1, publisher="Osprey", cover="d2"), None, None, None),
    (book("c29d", S, 1, cover="u", text_chars=90_000), "leave", 1, "to check"), (book("c29d", T, 1, publisher="Osprey", cover="v", text_chars=9_000), None, None, None),
    (book("c29e", S, 1, cover="same"), "trash", 1, "same cover"), (book("c29e", T, 1, publisher="Osprey", cover="same"), None, None, None),
    # only the years differ: the same cover overrules, another confirms, an unclear one leaves it
    (book("y1", S, 1, publisher="Osprey", year=1990, cover="s"), "trash", 1, "same cover"), (book("y1", T, 1, publisher="Osprey", year=2005, cover="s2"), None, None, None),
    (book("y2", S, 1, publisher="Osprey", year=1990, cover="d"), "move", 1, "different"), (book("y2", T, 1, publisher="Osprey", year=2005, cover="d2"), None, None, None),
    (book("y3", S, 1, publisher="Osprey", year=1990), "leave", 1, "to check"), (book("y3", T, 1, publisher="Osprey", year=2005), None, None, None),
    # a reading gives the edition that the record lacks
    (book("r1", S, 1, publisher="Osprey"), "trash", 1, "year+publisher"), (book("r1", T, 1, publisher="Osprey", year=1990), None, None, None),
    # formats that don't open
    (book("u1", S, 1, broken=["EPUB"]), "trash", None, "no format that opens"), (book("u2", S, 1, formats=["DOC"], foreign=["DOC"]), "leave", None, "no format that opens"),
    (book("u3", S, 1, isbns=[ISBN], formats=["EPUB", "PDF"], broken=["PDF"]), "trash", 1, "isbn"), (book("u3", T, 1, isbns=[ISBN], formats=["MOBI"]), None, None, None),
    # a target whose title is a file name may be the record
    (book("c34", S, 1, "Glass Island", ["Tove Lindqvist"]), "leave", 1, "held: may be hidden"), (book("c34", S, 2, "Salt Roads", ["Tove Lindqvist"]), "move", None, "nothing like it"), (book("c34", T, 1, "Harbour 0077", ["Tove Lindqvist"], file_title="Glass Island"), None, None, None),
    # surname only, no proof: to review
    (book("c38", S, 1, "Canvas", ["Delacroix"], publisher="Osprey", year=1990), "trash", 1, "year+publisher"), (book("c38", T, 1, "Canvas", ["Delacroix, Anne-Lise"], publisher="Osprey", year=1990), None, None, None),
]


def _fact_plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    books = _books(spark, sf_dir, FACTS)
    covers = spark.createDataFrame([("s", "s2", "same"), ("d", "d2", "different")], "a string, b string, answer string")
    readings = spark.createDataFrame([("r1", S, 1, None, None, 1990, []), ("r1", T, 1, None, None, 1990, [])], "lib string, side string, id bigint, publisher string, edition int, year int, isbns array<string>")
    readings = _over_parts(spark, sf_dir, readings, _libs(FACTS)).drop("part")
    options = ladder.Options(fix_swapped=True, cover_check=True, recheck_years=True, author_variants=True)
    return ladder.plan(books, options, _texts(spark, sf_dir), covers, readings), books


@query(_dealt([(b["lib"], b["id"], action, match, why) for b, action, match, why in FACTS if action], "lib, id, action, match, why", _libs(FACTS)))
def dedup_plan_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DL1, DL9-DL11b, DL13, PF7, PF8, PF10, PF11, TX10, TX11, JN7, JN8, JN13, IM5, AI4."""
    return _fact_plan(spark, sf_dir)[0].select("lib", "id", "action", "match", "why")


@query(_dealt([("c24", 1, "same text [title and author were swapped]", "", True), ("c28", 1, "isbn [1 is in another language]", "", True), ("c29a", 1, "nothing tells them apart", "no edition: compare them", False), ("c29b", 1, "same cover", "by the covers: compare them", False), ("u1", 1, "no format that opens", "EPUB open nowhere", False), ("u3", 1, "isbn [unreadable: PDF]", "", True), ("c38", 1, "year+publisher", "authors matched by the surname only", False)], "lib, id, reason, review, selected", _libs(FACTS)))
def plan_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DL15, DL18, AG11: reasons with their notes, and what is to be looked at first."""
    return _fact_plan(spark, sf_dir)[0].filter(F.split("lib", "-")[0].isin("c24", "c28", "c29a", "c29b", "u1", "u3", "c38")).select("lib", "id", "reason", "review", "selected")


TAGGED = [
    (book("c30", S, 1, "One", tags=["New"]), "leave", None), (book("c30", S, 2, "Two", tags=["new"]), "leave", None), (book("c30", S, 3, "Three"), None, None),
    (book("c31", S, 1, isbns=[ISBN], tags=["New"]), "trash", 2), (book("c31", S, 2, isbns=[ISBN], comments="rich"), None, None),
    (book("c32", S, 1, isbns=[ISBN], tags=["New"], comments="rich"), "leave", 2), (book("c32", S, 2, isbns=[ISBN]), None, None),
]


@query(_expected(TAGGED))
def tag_filter_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF4, JN11, DL16: only tagged records are decided, the others stay candidates."""
    from colophon.sources.catalogue import tag_selects

    return ladder.plan(_books(spark, sf_dir, TAGGED), ladder.Options(one_library=True), chosen=tag_selects(" NEW ")).select("lib", "id", "action", "match")


@query(_dealt([("c01", 1, "EPUB"), ("c05", 1, "MOBI")], "lib, id, added", _libs(TWO)))
def format_promises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF18, WN3, ST.U3."""
    books = _books(spark, sf_dir, TWO)
    return ladder.formats_to_add(ladder.plan(books, texts=_texts(spark, sf_dir)), books).select("lib", "id", F.col("add").alias("added"))


def _sides(spark: SparkSession, sf_dir: str, cases: list, **options: object) -> tuple[DataFrame, DataFrame]:
    feats = ladder.described(_books(spark, sf_dir, cases), ladder.Options(**options))
    return feats.filter("side = 'source'"), feats.filter("side = 'target'")


def _met(pairs: DataFrame) -> DataFrame:
    return pairs.select("lib", F.floor(F.col("id") / 2).cast("bigint").alias("id"), F.floor(F.col("cand") / 2).cast("bigint").alias("cand"))





@query(_dealt([("c21", 1, 1, False)], "lib, id, cand, weak", _libs(OPTIONAL)))
def fallback_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN5."""
    pairs = blocking.author_variants(*_sides(spark, sf_dir, OPTIONAL))
    return _met(pairs).join(pairs.select("lib", "weak"), "lib")



@query("""SELECT o_custkey a, count(DISTINCT o_orderkey) n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey""")
def dimension_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN15: facts to their dimension."""
    joined = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("o_custkey").alias("a")).agg(F.countDistinct("o_orderkey").alias("n"))


def identity(**given: object) -> tuple:
    base = {"publisher": None, "edition": None, "year": None, "ai_year": None, "ai_publisher": None, "isbns": [], "asins": [], "read": [], "series_name": None, "series_number": None}
    return tuple((base | given).values())


PAIRS = [
    (identity(isbns=["x"]), identity(isbns=["x", "y"]), "duplicate", True, False, False), (identity(isbns=["x"]), identity(isbns=["z"]), "unknown", False, False, False),
    (identity(edition=2, publisher="Osprey Books"), identity(edition=2, publisher="Osprey"), "duplicate", False, False, False), (identity(year=1990, publisher="Osprey"), identity(year=2005, publisher="Osprey"), "distinct", False, True, False),
    (identity(year=2003, publisher="Osprey"), identity(year=2017, publisher="Heron"), "distinct", False, False, False), (identity(edition=1, publisher="Osprey"), identity(edition=2, publisher="Osprey"), "distinct", False, False, False),
    (identity(publisher="Osprey"), identity(publisher="Kestrel"), "distinct", False, False, False), (identity(publisher="Osprey"), identity(publisher="Osprey"), "unknown", False, False, False),
    (identity(edition=2, publisher="Osprey"), identity(year=1965, publisher="Osprey"), "unknown", False, False, True), (identity(publisher="Osprey"), identity(year=1965), "unknown", False, False, True),
    (identity(), identity(year=1965, publisher="Osprey"), "unknown", False, False, False), (identity(year=1965, publisher="Osprey", ai_year=2005), identity(year=2005, publisher="Osprey", ai_year=2005), "duplicate", False, False, False),
    (identity(year=2005, publisher="Osprey", ai_year=1990), identity(year=2005, publisher="Osprey", ai_year=2005), "distinct", False, False, False),
    (identity(edition=1, ai_year=2016, read=["edition"]), identity(edition=1, ai_year=2016, read=["edition"]), "duplicate", False, False, False),
]


def _pairs(spark: SparkSession) -> DataFrame:
    rows = [(i, p[0], p[1]) for i, p in enumerate(PAIRS)]
    return with_publishers(spark.createDataFrame(rows, f"n int, a {IDENTITY}, b {IDENTITY}")).withColumn("v", verdict())


@stated(values_sql([(i, *p[2:]) for i, p in enumerate(PAIRS)], "n, verdict, proof, year_only, incomparable"))
def compare_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DL7."""
    return _pairs(spark).select("n", "v.verdict", "v.proof", "v.year_only", "v.incomparable")


@stated(values_sql([("a", "duplicate", 2), ("b", "unknown", None), ("c", "distinct", None)], "src, verdict, match_ord"))
def decide_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG7, WN6."""
    picks = [("a", 0, 3), ("a", 1, 1), ("a", 2, 2), ("a", 3, 0), ("b", 0, 3), ("b", 1, 1), ("c", 0, 3)]
    chosen = spark.createDataFrame(picks, "src string, ord int, n int").join(_pairs(spark), "n")
    return decide(chosen, ["src"]).select("src", "verdict", "match_ord")


COVERS = [("open", "same", False, False, "duplicate, to review"), ("open", "different", False, False, None), ("open", "unclear", False, False, "duplicate without edition, to review"), ("open", "unclear", True, False, None), ("incomparable", "same", False, False, "duplicate, to review"), ("incomparable", "unclear", False, False, None), ("weak", "same", False, False, "duplicate, overriding, to review"), ("weak", "different", False, False, "distinct"), ("weak", "skipped", False, False, None), ("different", "same", False, True, "duplicate, overriding, to review"), ("different", "unclear", False, True, "distinct"), ("different", "same", False, False, None)]


@stated(values_sql(COVERS, "kind, cover, longer, always, result"))
def cover_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DL11."""
    df = spark.createDataFrame([c[:4] for c in COVERS], "kind string, cover string, longer boolean, always boolean")
    return df.withColumn("result", by_cover(*(F.col(c) for c in df.columns)))


SWAPS = [(1, "Almqvist", ["The Inn at the End of a Road"]), (2, "Salt Roads", ["Almqvist"]), (3, "Delacroix", ["Peter Oakes"]), (4, "Moreau", ["Peter Oakes"]), (5, "Canvas", ["Delacroix"])]


@query(_dealt([("l", 1)], "lib, id", ["l"]))
def swap_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN7, PF10."""
    from colophon.functions.titles import title_key

    rows = spark.createDataFrame([("l", *s) for s in SWAPS], "lib string, id bigint, title string, authors array<string>")
    return blocking.swapped(_over_parts(spark, sf_dir, rows, ["l"]).drop("part").withColumn("title_key", title_key("title")))


HIDING = [(book("h1", S, 1, "Glass island", ["T. Lindqvist"]), None, None), (book("h1", S, 2, "Copper", ["T. Lindqvist"]), None, None), (book("h1", T, 1, "Harbour 0077", ["T. Lindqvist"], file_title="Glass Island"), None, None), (book("h2", S, 1, "Copper", ["T. Lindqvist"]), None, None), (book("h2", T, 1, "Harbour 0078", ["T. Lindqvist"]), None, None)]


@query(_dealt([("h1", 1, 1)], "lib, id, hidden_by", _libs(HIDING)))
def may_hide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN8."""
    got = blocking.may_hide(*_sides(spark, sf_dir, HIDING))
    return got.select("lib", F.floor(F.col("id") / 2).cast("bigint").alias("id"), F.floor(F.col("hidden_by") / 2).cast("bigint").alias("hidden_by"))


REPLIES = [
    (1, 'Sure: {"title": " Tides ", "authors": "Tove Almqvist", "publisher": "null", "year": 1965, "series": "Tides", "series_index": "1,5", "isbn": ["0-306-40615-2", "bad"], "language": "it", "cover": "Text"} done', "Tides", "Tove Almqvist", None, 1965, 1.5, "9780306406157", "ita", "text", True),
    (2, "", None, "", None, None, None, "", None, None, True), (3, "no json here", None, None, None, None, None, None, None, None, False),
    (4, '{"title": "X", "authors": ["A", " B "], "year": 99}', "X", "A|B", None, None, None, "", None, None, True),
]


@stated(values_sql([(r[0], *r[2:]) for r in REPLIES], "id, title, authors, publisher, year, series_index, isbn, language, cover, ok", "* REPLACE (series_index::DOUBLE AS series_index)"))
def answers_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AI1, AI2."""
    df = spark.createDataFrame([r[:2] for r in REPLIES], "id int, reply string").withColumn("r", review.parse_reply("reply"))
    return df.select("id", "r.title", F.array_join("r.authors", "|").alias("authors"), "r.publisher", "r.year", "r.series_index", F.array_join("r.isbn", "|").alias("isbn"), "r.language", "r.cover", F.col("r").isNotNull().alias("ok"))


READING = "struct<title:string,authors:array<string>,publisher:string,year:int,series:string,series_index:double,isbn:array<string>,language:string>"
SALE = ("Le strade di sale", ["Paolo Querci"], "Falco", 1980)


def _reading(title: str | None = SALE[0], authors: list[str] = SALE[1], publisher: str | None = SALE[2], year: int | None = SALE[3], series: str | None = None, index: float | None = None, isbn: list[str] = (), language: str | None = None) -> tuple:
    return title, authors, publisher, year, series, index, list(isbn), language


PAGE = "le strade di sale paolo querci falco 1983 isbn 9780306406157"
REVIEWS = [
    # id, title, authors, publisher, year, isbns, languages, series, number, reading, text; then the changes expected
    ((1, *SALE, [], [], None, None, _reading("LE STRADE DI SALE", ["Querci, Paolo"], "Falco Editore"), PAGE), []),
    ((2, *SALE, [], [], None, None, _reading(None, [], None, None), PAGE), []),
    ((3, "Tides parte 2", ["F H"], None, None, [], [], None, None, _reading("Tides", ["F H"], None, None), PAGE), []),
    ((4, *SALE, [], [], None, None, _reading(year=1983), PAGE), [("year", "1983", None)]),
    ((5, *SALE, [], [], None, None, _reading(year=1984), PAGE), [("year", "1984", "new value not printed")]),
    ((6, *SALE, [], [], None, None, _reading(year=1983), None), [("year", "1983", "not checked")]),
    ((7, SALE[0], ["Paolo Querci", "Eva Holm"], SALE[2], SALE[3], [], [], None, None, _reading(), PAGE), [("authors", "Paolo Querci", "author lost")]),
    ((8, *SALE, [], [], "galaxy", 1.0, _reading(series="Galaxy", index=2345.0), PAGE), [("series", "galaxy [2345]", "new value not printed")]),
    ((9, *SALE, [], [], None, None, _reading(isbn=["9780306406157"], language="ita"), PAGE), [("isbn", "9780306406157", None), ("language", "ita", "language not in text")]),
    ((10, SALE[0], SALE[1], None, SALE[3], [], [], None, None, _reading(publisher="Paolo Querci"), PAGE), [("publisher", "Paolo Querci", "author as publisher")]),
    ((11, "le_strade_di_sale", SALE[1], SALE[2], SALE[3], [], [], None, None, _reading(), PAGE), [("title", "Le strade di sale", None)]),
    ((12, "Galaxy N 04", SALE[1], SALE[2], SALE[3], [], [], None, None, _reading("Galaxy Italia"), PAGE), [("title", "Galaxy Italia", "number lost")]),
]
_REVIEW = f"id int, title string, authors array<string>, publisher string, year int, isbns array<string>, languages array<string>, series string, series_number double, found {READING}, text string"


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part has one of the cases, numbered by its key and the case."""
    rows = spark.createDataFrame([r for r, _ in REVIEWS], _REVIEW)
    parts = spread(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"))
    dealt = parts.join(F.broadcast(rows), F.col("part") % len(REVIEWS) + 1 == F.col("id"))
    return review.evidence(dealt.withColumn("id", F.col("part") * 100 + F.col("id")).drop("part"))


def _review_sql(rows: list[tuple], names: str) -> str:
    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"SELECT p_partkey * 100 + c.id AS id, {', '.join(f'c.{n} AS {n}' for n in names.split(', ')[1:])} FROM part JOIN (VALUES {body}) c({names}) ON p_partkey % {len(REVIEWS)} + 1 = c.id"


@query(_review_sql([(r[0], f, p) for r, cs in REVIEWS for f, p, _ in cs], "id, field, proposed"))
def review_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF12, ID6."""
    return review.changes(_reviewed(spark, sf_dir)).select("id", "field", "proposed")


@query(_review_sql([(r[0], f, d) for r, cs in REVIEWS for f, _, d in cs], "id, field, doubt"))
def review_doubts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF13, TX12, TX13."""
    return review.doubts(review.changes(_reviewed(spark, sf_dir))).select("id", "field", "doubt")


_PLAN = "lib string, id bigint, title string, action string, planned string, match bigint, match_side string, add string, selected boolean, status string, review string, by_cover boolean, swapped boolean"
ITEMS = [
    ("p", 1, "Tides", "move", "move", None, None, "", False, "", "", False, False), ("p", 2, "Tides", "trash", "trash", 1, "source", "", True, "", "", False, False),
    ("p", 3, "Città di nebbia", "leave", "leave", 100, "target", "", False, "done", "weak", True, False), ("p", 4, "Glass", "leave", "leave", None, None, "", False, "", "", False, True),
    ("p", 5, "Tides", "trash", "trash", 2, "source", "MOBI", True, "", "", True, True), ("p", 6, "Saga", "move", "move", None, None, "", True, "", "", False, False),
]


def _items(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ITEMS, _PLAN)


@stated(values_sql([("leave", 1), ("leave_unique", 1), ("merge", 1), ("move", 2), ("trash", 1), ("by_cover", 2), ("swapped", 2), ("other", 3)], "key, n"))
def plan_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF19, PF20, PF23."""
    df = _items(spark).withColumn("actions", F.array(selection.action_key())).withColumn("kinds", selection.kinds(["by_cover", "swapped"]))
    return selection.facet_counts(df, "actions").union(selection.facet_counts(df, "kinds")).withColumnRenamed("count", "n")


@stated(values_sql([("p", 3)], "lib, id"))
def plan_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF21, PF22."""
    df = _items(spark).withColumn("states", selection.status_keys())
    return selection.accept(df, {"states": ["done"], "action": ["leave", "move"]}, "citta NEBBIA", ["title", "action"]).select("lib", "id")


@stated(values_sql([("p", 2, 2, 2, 6)], "lib, moves, trashed, kept, n"))
def plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG9, AG10."""
    count = lambda a: F.count_if(F.col("action") == a)
    return _items(spark).groupBy("lib").agg(count("move").alias("moves"), count("trash").alias("trashed"), count("leave").alias("kept"), F.count("*").alias("n"))


@stated(values_sql([(3, 1), (4, 2), (6, 3), (1, 4), (2, 5), (5, 6)], "id, place"))
def plan_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO1, SO2: by folded title, then id."""
    from pyspark.sql import Window

    from colophon.functions.text import key

    return _items(spark).select("id", F.row_number().over(Window.partitionBy("lib").orderBy(key("title"), "id")).alias("place"))


@stated(values_sql([("p", 2, "copy isn't moved"), ("p", 5, "kept copy goes")], "lib, id, why"))
def blocked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SL4, JN16."""
    return selection.blocked(_items(spark))


@stated(values_sql([("p", 1), ("p", 2), ("p", 5)], "lib, id"))
def redecide_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DL17, JN11."""
    return selection.redecide(_items(spark), spark.createDataFrame([("p", 1)], "lib string, id bigint"))


@stated(values_sql([(1, "leave", False, True), (2, "trash", False, False), (3, "leave", False, False), (4, "leave", False, False), (5, "trash", True, False), (6, "move", True, False)], "id, action, selected, manual"))
def selection_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN18, SL1, SL7."""
    saved = spark.createDataFrame([("p", 1, "leave", None), ("p", 2, "trash", False)], "lib string, id bigint, action string, selected boolean")
    return selection.apply_choices(_items(spark), saved).select("id", "action", "selected", "manual")


_NOW = "2024-01-01T00:00:00.5"
SHELF = [("p", S, 1, _NOW, ["EPUB"]), ("p", S, 2, _NOW, ["EPUB", "MOBI"]), ("p", S, 6, "2024-02-02T00:00:00", ["PDF"]), ("p", T, 9, _NOW, ["EPUB"])]
TODO = [("p", 1, "move", None, None, "", _NOW[:19], None), ("p", 2, "trash", 9, T, "MOBI", _NOW, _NOW), ("p", 6, "move", None, None, "", _NOW, None), ("p", 7, "move", None, None, "", _NOW, None)]


def _done(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    shelf = spark.createDataFrame(SHELF, "lib string, side string, id bigint, version string, formats array<string>")
    todo = spark.createDataFrame(TODO, "lib string, id bigint, action string, match bigint, match_side string, add string, stamp string, match_stamp string")
    return shelf, execute.checked(todo, shelf)


@stated(values_sql([(1, True, None), (2, True, None), (6, False, "record changed"), (7, False, "record is gone")], "id, ok, why"))
def action_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX1, EX3."""
    return _done(spark)[1].select("id", "ok", "why")


@stated(values_sql([(1, T, "EPUB"), (2, "trash", "EPUB,MOBI"), (6, S, "PDF"), (9, T, "EPUB,MOBI")], "id, side, formats"))
def apply_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX4-EX6, SL11."""
    shelf, done = _done(spark)
    return execute.applied(shelf, done).select("id", "side", F.array_join("formats", ",").alias("formats"))


@stated(values_sql([(1, "move", None), (2, "merge MOBI", 9)], "id, done, match"))
def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK3."""
    return execute.journal(_done(spark)[1]).select("id", "done", "match")


@stated(values_sql([("b", "rows added or removed"), ("c", "rows changed"), ("d", "gone"), ("e", "new")], "lib, why"))
def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG13, SL9."""
    kind = "lib string, id bigint, version string"
    before = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("b", 1, "x"), ("c", 1, "x"), ("d", 1, "x")], kind)
    now = spark.createDataFrame([("a", 2, "x"), ("a", 1, "x"), ("b", 1, "x"), ("b", 2, "x"), ("c", 1, "y"), ("e", 1, "x")], kind)
    return selection.stale(selection.library_state(before), selection.library_state(now))
