"""Queries over reviewed records, plans in use and their reports, held against stated results or SQL over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.operators import blocking
from colophon.plans import edit, execute, selection
from colophon.plans.features import BOOKS, features
from colophon.queries import query, read, spread, stated, values_sql

_SHELF = "lib string, side string, id bigint, title string, authors array<string>, publisher string, year int, series string, series_number double, isbns array<string>, languages array<string>, tags array<string>, formats array<string>"
SHELF = [
    ("p", "source", 1, "Salt Roads", ["Peter Oakes"], "Osprey", 1990, "Tides", 2.0, [], ["eng"], ["x"], ["EPUB"]),
    ("p", "source", 2, "Unknown", ["Unknown"], None, None, None, None, ["9780804429573"], [], ["aireviewed"], ["EPUB", "PDF"]),
    ("p", "source", 3, "Canvas", ["Eva Holm"], None, 2001, None, None, [], [], [], ["PDF"]),
    ("p", "source", 4, "Tides", ["Eva Holm"], None, None, None, None, [], [], [], ["EPUB"]),
]
_FOUND = "struct<title:string,authors:array<string>,publisher:string,year:int,series:string,series_index:double,isbn:array<string>,language:string>"
FOUND = [("p", 1, ("Salt Roads", ["P. Oakes"], "osprey", 1991, "Tides", 3.0, ["9780804429573", "9781843560289"], "fra")), ("p", 2, ("Glass Island", ["Tove Lindqvist"], None, None, None, None, ["9780804429573"], None))]
VALUES = {1: [("title", "Salt Roads", "Salt Roads"), ("authors", "Peter Oakes", "P. Oakes"), ("publisher", "Osprey", "osprey"), ("year", "1990", "1991"), ("series", "Tides [2]", "Tides [3]"), ("isbn", None, None), ("language", "eng", "fra")], 2: [("title", None, "Glass Island"), ("authors", None, "Tove Lindqvist"), ("publisher", None, None), ("year", None, None), ("series", None, None), ("isbn", "9780804429573", "9780804429573"), ("language", None, None)]}


def _dealt(spark: SparkSession, sf_dir: str, df: DataFrame, records: int = 5) -> DataFrame:
    """Each part, as a library of its own, has the rows of one record, by its key."""
    parts = spread(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"))
    dealt = parts.join(F.broadcast(df), F.col("part") % records + 1 == F.col("id"))
    return dealt.withColumn("lib", F.concat("lib", F.lit("-"), F.col("part").cast("string"))).drop("part")


def _dealt_sql(rows: list[tuple], names: str, casts: str = "*", records: int = 5) -> str:
    return f"SELECT c.* FROM part JOIN ({values_sql(rows, names, casts)}) c ON p_partkey % {records} + 1 = c.id"


def _shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt(spark, sf_dir, spark.createDataFrame(SHELF, _SHELF))


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _dealt(spark, sf_dir, spark.createDataFrame(FOUND, f"lib string, id bigint, found {_FOUND}"))
    return edit.field_values(_shelf(spark, sf_dir).join(found, ["lib", "id"]))


@query(_dealt_sql([(i, *v) for i, vs in VALUES.items() for v in vs], "id, field, current, read"))
def review_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF26, ID5."""
    return _values(spark, sf_dir).drop("lib")


_PROPOSED = "lib string, id bigint, field string, current string, proposed string, doubt string, excluded boolean"
PROPOSED = [("p", 1, "year", "1990", "1991", None, None), ("p", 1, "publisher", "Osprey", "osprey", None, None), ("p", 1, "series", "Tides [2]", "Tides [3]", None, None), ("p", 1, "language", "eng", "fra", "language not in text", None), ("p", 2, "title", None, "Glass Island", None, True), ("p", 4, "isbn", None, "9781843560289", None, None)]
_DECISION = "lib string, id bigint, action string, manual boolean, reviewed boolean, selected boolean, broken array<string>, foreign array<string>, formats array<string>, was_read boolean, tags array<string>, bad_cover boolean"
DECISIONS = [("p", 1, None, None, None, None, [], [], ["EPUB"], True, ["x"], False), ("p", 2, None, None, True, None, ["PDF"], [], ["EPUB", "PDF"], True, ["aireviewed"], True), ("p", 3, None, None, None, None, ["PDF"], [], ["PDF"], False, [], True), ("p", 4, "update", True, None, True, [], [], ["EPUB"], True, [], False), ("p", 5, None, None, None, None, [], [], ["EPUB"], True, [], False)]


def _proposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt(spark, sf_dir, spark.createDataFrame(PROPOSED, _PROPOSED))


def _defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit.defaults(_dealt(spark, sf_dir, spark.createDataFrame(DECISIONS, _DECISION)), _proposed(spark, sf_dir))


@query(_dealt_sql([(1, "year"), (1, "publisher"), (4, "isbn")], "id, field"))
def review_to_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF15, with the series turned off."""
    return edit.to_write(_proposed(spark, sf_dir), tuple(f for f in edit.FIELDS if f != "series")).select("id", "field")


@query(_dealt_sql([(1, "update", True, True, False), (2, "keep", True, False, True), (3, "trash", True, False, False), (4, "update", True, False, True), (5, "keep", False, False, True)], "id, shown, ticked, to_review, done"))
def review_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF16, PF17."""
    return _defaults(spark, sf_dir).select("id", "shown", "ticked", "to_review", "done")


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit.review_actions(_defaults(spark, sf_dir), _proposed(spark, sf_dir))


@query(_dealt_sql([(1, "set", "publisher,series,year", None, None), (2, "trash_formats", None, "PDF", None), (2, "tag", None, None, "BadCover"), (3, "trash", None, None, None), (4, "set", "isbn", None, "AIReviewed"), (5, "tag", None, None, "AIReviewed")], "id, op, fields, formats, tag"))
def review_change_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX2, IM7."""
    keys = F.array_join(F.array_sort(F.map_keys("fields")), ",")
    return _actions(spark, sf_dir).select("id", "op", keys.alias("fields"), F.array_join("formats", ",").alias("formats"), "tag")


@query(_dealt_sql([(1, "Salt Roads", "Osprey", 1991, "Tides", 3.0, "", "eng", "x,AIUpdated"), (2, "Unknown", None, None, None, None, "9780804429573", "", "aireviewed,BadCover"), (3, "Canvas", None, 2001, None, None, "", "", ""), (4, "Tides", None, None, None, None, "9781843560289", "", "AIReviewed,AIUpdated")], "id, title, publisher, year, series, series_number, isbns, languages, tags", "* REPLACE (series_number::DOUBLE AS series_number)"))
def review_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX7, EX8, EX10: fields are set, a publisher that differs in case keeps the library's spelling, and tags are added once."""
    actions = _actions(spark, sf_dir)
    names = _shelf(spark, sf_dir).filter("publisher is not null").select("lib", F.col("publisher").alias("name"))
    books = edit.spelled(edit.with_fields(_shelf(spark, sf_dir), actions), "publisher", names)
    text = lambda c: F.array_join(c, ",").alias(c)
    return edit.with_tag(books, edit.action_tags(actions)).select("id", "title", "publisher", "year", "series", "series_number", text("isbns"), text("languages"), text("tags"))


@query("""SELECT o_orderkey, CASE WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN make_date(2001, 2, 28) ELSE make_date(2001, month(o_orderdate), day(o_orderdate)) END moved FROM orders""")
def dates_in_another_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX7 over all order dates."""
    return read(spark, sf_dir, "orders").select("o_orderkey", edit.new_date(F.col("o_orderdate").cast("date"), F.lit(2001)).alias("moved"))


_PLAN = "lib string, id bigint, action string, planned string, match bigint, match_side string, selected boolean, planned_selected boolean, manual boolean, reviewed boolean, status string, review string, cleanup boolean"
ITEMS = [
    ("p", 1, "leave", "move", None, None, False, True, True, False, "", "", False), ("p", 2, "trash", "trash", 1, "source", True, True, False, False, "", "", False), ("p", 3, "move", "move", None, None, True, True, False, False, "", "", False),
    ("p", 4, "leave", "leave", 9, "target", True, True, False, False, "", "no edition", True), ("p", 5, "trash", "trash", 9, "target", False, False, False, True, "", "covers", False), ("p", 6, "trash", "trash", 3, "source", True, True, False, False, "done", "", False),
]


def _items(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ITEMS, _PLAN)


@stated(values_sql([(1, "move", True), (2, "trash", True), (3, "move", True), (4, "leave", True), (5, "trash", False), (6, "trash", True)], "id, action, selected"))
def plan_reverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SL2."""
    return selection.reverted(_items(spark)).select("id", "action", "selected")


@stated(values_sql([(1, True, False, False, False), (2, False, False, True, False), (3, False, False, True, False), (4, False, True, True, True), (5, True, False, True, True), (6, False, False, True, False)], "id, changed, needs_review, checkable, reviewed"))
def plan_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SL3, SL5."""
    df = _items(spark)
    marked = selection.mark_reviewed(df).select("id", "reviewed")
    return df.select("id", selection.is_changed().alias("changed"), selection.needs_review().alias("needs_review"), selection.checkable().alias("checkable")).join(marked, "id")


@stated(values_sql([(3, True), (4, False)], "id, runs"))
def plan_actionable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SL5: the second row is blocked, since the copy that it rests on isn't moved."""
    return selection.actionable(_items(spark)).select("id", "runs")


@stated(values_sql([(1,), (2,), (3,), (4,), (5,)], "id"))
def plan_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SL12."""
    return selection.remaining(_items(spark)).select("id")


@stated(values_sql([(1, "leave", False), (5, "trash", False), (77, "move", True)], "id, action, selected"))
def choices_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SL7: older choices of records that the plan doesn't hold stay, others are replaced."""
    old = spark.createDataFrame([("p", 77, "move", True), ("p", 2, "leave", False)], "lib string, id bigint, action string, selected boolean")
    return selection.saved_choices(old, _items(spark)).drop("lib")


@stated(values_sql([(2, 30, "target", ""), (6, 30, "target", "done"), (3, None, None, "done")], "id, match, match_side, status"))
def plan_after_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SL11: the third record was moved and is number 30 in the target."""
    items = _items(spark).withColumn("match", F.when(F.col("id") == 2, 3).otherwise(F.col("match")))
    results = spark.createDataFrame([("p", 3, True, 30)], "lib string, id bigint, ok boolean, moved_to bigint")
    return selection.after_run(items, results).filter("id in (2, 3, 6)").select("id", "match", "match_side", "status")


@stated(values_sql([(2, "trash", "judged duplicate (91%)", False), (3, "move", "judged different (60%)", False), (4, "leave", "judged unsure (10%)", False)], "id, action, review, selected"))
def plan_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SL8."""
    said = spark.createDataFrame([("p", 2, "duplicate", 91.5), ("p", 3, "different", 60.0), ("p", 4, "unsure", 10.0)], "lib string, id bigint, verdict string, confidence double")
    return selection.judged(_items(spark), said).filter("id in (2, 3, 4)").select("id", "action", "review", "selected")


@stated(values_sql([("/a/b -> /c",), ("/a/b -> /c #tag:new,x",), ("/a/b -> /c #not-tag:new",)], "k"))
def pair_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SL6."""
    df = spark.createDataFrame([("/A/b", "/C", None, False), ("/a/B", "/c", " X, new ,x", False), ("/a/b", "/c", "New", True)], "s string, t string, tags string, x boolean")
    return df.select(selection.pair_key(*(F.col(c) for c in df.columns)).alias("k"))


@stated(values_sql([(1, "target", "EPUB"), (2, "trash", "EPUB"), (3, "source", "EPUB"), (3, "trash", "EPUB,PDF"), (9, "target", "EPUB,MOBI"), (1, "kept", "EPUB")], "id, side, formats"))
def formats_taken_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX4-EX6: a move, a copy that goes after its match gained a format, and a format taken out with the whole record kept in the trash."""
    kind = "lib string, side string, id bigint, formats array<string>"
    books = spark.createDataFrame([("p", "source", 1, ["EPUB"]), ("p", "source", 2, ["EPUB"]), ("p", "source", 3, ["EPUB", "PDF"]), ("p", "target", 9, ["EPUB"]), ("q", "kept", 1, ["EPUB"])], kind)
    done = spark.createDataFrame([("p", 1, "move", None, None, "", True, []), ("p", 2, "trash", 9, "target", "MOBI", True, []), ("p", 3, "leave", None, None, "", True, ["PDF"]), ("q", 1, "move", None, None, "", False, ["EPUB"])], "lib string, id bigint, action string, match bigint, match_side string, add string, ok boolean, take_out array<string>")
    return execute.applied(books, done).select("id", "side", F.array_join("formats", ",").alias("formats"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as records: even keys are sources, odd ones targets; the name is the title, the brand the author."""
    given = {"lib": F.lit("parts"), "side": F.when(F.col("p_partkey") % 2 == 0, "source").otherwise("target"), "id": F.col("p_partkey"), "title": F.col("p_name"), "authors": F.array("p_brand"), "formats": F.array(F.lit("EPUB"))}
    names = [f.split()[0:2] for f in BOOKS.split(", ")]
    empty = lambda kind: F.array().cast(kind) if kind.startswith("array") else F.lit(None).cast(kind)
    return spread(spark, sf_dir, "part").select(*(given.get(n, empty(kind)).alias(n) for n, kind in names))


_TITLE = r"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT a.p_partkey id, count(*) n, min(b.p_partkey) first FROM part a JOIN part b ON {_TITLE.format(x='a.p_name')} = {_TITLE.format(x='b.p_name')} AND a.p_brand = b.p_brand WHERE a.p_partkey % 2 = 0 AND b.p_partkey % 2 = 1 GROUP BY a.p_partkey")
def block_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN1 over all parts: how many targets have the title and the author of each source, and the first of them."""
    feats = features(_parts(spark, sf_dir)).withColumn("ord", F.col("id"))
    return blocking.counted(feats.filter("side = 'source'"), feats.filter("side = 'target'"), blocking.STRICT, blocking.strict).select("id", "n", "first")


@query(f"SELECT a.p_brand brand, count(DISTINCT {_TITLE.format(x='a.p_name')}) titles, count(*) n FROM part a GROUP BY a.p_brand")
def part_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST8, NM2, PF1 over all parts: different title keys of each author."""
    feats = features(_parts(spark, sf_dir))
    return feats.groupBy(F.get("authors", F.lit(0)).alias("brand")).agg(F.countDistinct("title_key").alias("titles"), F.count("*").alias("n"))
