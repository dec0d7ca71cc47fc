"""Reviewed records: fields in one form, what is to be written, default actions, and changes to the catalogue.

A proposal is a row for each field that was read differently: (lib, id, field, current, proposed, doubt, excluded). A decision is
a row for each record: (lib, id, action, manual, reviewed, selected, broken, foreign, formats, was_read).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.functions import ids, text

FIELDS = ("title", "authors", "publisher", "year", "series", "isbn", "language")
REVIEWED, UPDATED, BAD_COVER = "AIReviewed", "AIUpdated", "BadCover"


def _series(name: Column, number: Column) -> Column:
    return F.when(name.isNotNull(), ids.series_text(name, number))


def field_values(df: DataFrame) -> DataFrame:
    """PF26: (lib, id, field, current, read): what the record and its reading ``found`` say of each field, in one form; null for nothing."""
    f = lambda n: F.col(f"found.{n}")
    known = F.filter("authors", lambda a: ~text.is_unknown(a))
    filled = lambda a: F.nullif(F.array_join(a, " & "), F.lit(""))
    pairs = {
        "title": (F.when(~text.is_unknown("title"), F.col("title")), f("title")),
        "authors": (filled(known), filled(f("authors"))),
        "publisher": (F.col("publisher"), f("publisher")),
        "year": (F.col("year").cast("string"), f("year").cast("string")),
        "series": (_series(F.col("series"), F.col("series_number")), _series(f("series"), f("series_index"))),
        "isbn": (F.array_min("isbns"), F.when(F.size(f("isbn")) == 1, F.get(f("isbn"), F.lit(0)))),
        "language": (F.get("languages", F.lit(0)), f("language")),
    }
    cells = F.array(*(F.struct(F.lit(n).alias("field"), a.alias("current"), b.alias("read")) for n, (a, b) in pairs.items()))
    return df.select("lib", "id", F.explode(cells).alias("c")).select("lib", "id", "c.*")


def to_write(proposals: DataFrame, fields_on: tuple[str, ...] = FIELDS) -> DataFrame:
    """PF15: proposals of fields that are on, neither doubted nor left out."""
    return proposals.filter(F.col("field").isin(*fields_on) & F.col("doubt").isNull() & ~F.coalesce("excluded", F.lit(False)))


def defaults(decisions: DataFrame, proposals: DataFrame, fields_on: tuple[str, ...] = FIELDS) -> DataFrame:
    """PF16, PF17, IM7: ``shown`` (update, keep or trash), ``ticked``, ``cleanup``, ``to_review`` and ``done`` (nothing more to do) of each record.

    An action that isn't manual follows from the proposals: something to write is an update, no file that opens at all is trash.
    """
    count = lambda df, name: df.groupBy("lib", "id").agg(F.count("*").alias(name))
    doubted = proposals.filter(F.col("doubt").isNotNull() & F.col("field").isin(*fields_on))
    df = decisions
    for part, name in ((proposals, "n_all"), (to_write(proposals, fields_on), "n_write"), (doubted, "n_doubt")):
        df = df.join(count(part, name), ["lib", "id"], "left").withColumn(name, F.coalesce(name, F.lit(0)))
    no_list, no = F.array().cast("array<string>"), F.lit(False)
    broken, foreign = F.coalesce("broken", no_list), F.coalesce("foreign", no_list)
    nothing_opens = (F.size("formats") == 0) | ((F.size(broken) > 0) & (F.size(F.array_except("formats", broken)) == 0))
    manual = F.coalesce("manual", no)
    action = F.when(manual, F.col("action")).when(F.col("n_all") > 0, "update").when(nothing_opens, "trash").otherwise(F.coalesce("action", F.lit("keep")))
    closed = F.size(F.array_except("formats", F.concat(broken, foreign))) == 0
    df = df.withColumn("action", action).withColumn("cleanup", (F.size(broken) > 0) & ~closed & (F.col("action") != "trash"))
    shown = F.when((F.col("action") == "update") & ~manual & (F.col("n_write") == 0), "keep").otherwise(F.col("action"))
    ticked = F.when(manual, F.col("selected")).otherwise((F.col("action") == "trash") | ((F.col("action") == "update") & (F.col("n_write") > 0)) | F.col("cleanup"))
    df = df.withColumn("shown", shown).withColumn("ticked", F.coalesce(ticked, no)).withColumn("to_review", (F.col("n_doubt") > 0) & ~manual & ~F.coalesce("reviewed", no))
    proposes = (F.col("shown").isin("update", "trash") & ((F.col("shown") == "trash") | (F.col("n_write") > 0))) | F.col("cleanup")
    done = ~F.col("to_review") & (manual | F.coalesce("reviewed", no) | (F.coalesce("was_read", no) & (F.col("ticked") | ~proposes)))
    return df.withColumn("done", done).drop("n_all", "n_write", "n_doubt")


def review_actions(decided: DataFrame, proposals: DataFrame, fields_on: tuple[str, ...] = FIELDS) -> DataFrame:
    """EX2: (lib, id, op, fields, formats, tag): what the ticked rows of ``defaults`` do, then the tags.

    ``op`` is trash, set, trash_formats or tag; a set also names the tag of records that are done.
    """
    values = to_write(proposals, fields_on).groupBy("lib", "id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "proposed")))).alias("fields"))
    df = decided.join(values, ["lib", "id"], "left")
    tagged = F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(t) == REVIEWED.lower())
    sets = F.col("ticked") & (F.col("shown") == "update") & F.col("fields").isNotNull()
    op = F.when(F.col("ticked") & (F.col("shown") == "trash"), "trash").when(sets, "set").when(F.col("ticked") & F.col("cleanup"), "trash_formats")
    formats = F.when(F.col("cleanup") & F.col("ticked"), F.array_sort("broken"))
    main = df.withColumn("op", op).filter("op is not null").select("lib", "id", "op", F.when(F.col("op") == "set", F.col("fields")).alias("fields"), F.when(F.col("op") != "trash", formats).alias("formats"), F.when((F.col("op") == "set") & F.col("done"), REVIEWED).alias("tag"))
    trash = F.col("ticked") & (F.col("shown") == "trash")
    none = [F.lit(None).cast("map<string,string>").alias("fields"), F.lit(None).cast("array<string>").alias("formats")]
    reviewed = df.filter(F.col("done") & ~sets & ~trash & ~tagged).select("lib", "id", F.lit("tag").alias("op"), *none, F.lit(REVIEWED).alias("tag"))
    covers = df.filter(F.coalesce("bad_cover", F.lit(False)) & ~trash).select("lib", "id", F.lit("tag").alias("op"), *none, F.lit(BAD_COVER).alias("tag"))
    return main.union(reviewed).union(covers)


def new_date(date: Column, year: Column) -> Column:
    """EX7: the date in another year, a leap day becoming the 28th; dates before 1400 stand for none and give 1 January."""
    leap = (F.month(date) == 2) & (F.dayofmonth(date) == 29)
    return F.when(F.year(date) >= 1400, F.make_date(year, F.month(date), F.when(leap, 28).otherwise(F.dayofmonth(date)))).otherwise(F.make_date(year, F.lit(1), F.lit(1)))


def spelled(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """EX7: values of ``column`` as the library spells them: ``names(lib, name)`` wins where only the case differs."""
    own = names.select("lib", F.lower("name").alias("_k"), "name").groupBy("lib", "_k").agg(F.min("name").alias("_own"))
    return df.withColumn("_k", F.lower(column)).join(own, ["lib", "_k"], "left").withColumn(column, F.coalesce("_own", column)).drop("_k", "_own")


def with_fields(books: DataFrame, actions: DataFrame) -> DataFrame:
    """EX7, EX10: the catalogue after its set actions. An ISBN is added only where there is none; the language replaces all languages."""
    sets = actions.filter("op = 'set'").select("lib", "id", "fields")
    df = books.join(sets, ["lib", "id"], "left")
    # without an action there is no map, and so no value
    value = lambda n: F.try_element_at("fields", F.lit(n))
    series = F.regexp_extract(value("series"), r"^(.*?)(?: \[([0-9.]+)\])?$", 1)
    number = F.nullif(F.regexp_extract(value("series"), r" \[([0-9.]+)\]$", 1), F.lit("")).try_cast("double")
    out = {
        "title": F.coalesce(value("title"), F.col("title")),
        "authors": F.when(value("authors").isNotNull(), F.split(value("authors"), " & ")).otherwise(F.col("authors")),
        "publisher": F.coalesce(value("publisher"), F.col("publisher")),
        "year": F.coalesce(value("year").cast("int"), F.col("year")),
        "series": F.coalesce(series, F.col("series")),
        "series_number": F.when(value("series").isNotNull(), F.coalesce(number, F.col("series_number"))).otherwise(F.col("series_number")),
        "isbns": F.when((F.size("isbns") == 0) & value("isbn").isNotNull(), F.array(value("isbn"))).otherwise(F.col("isbns")),
        "languages": F.when(value("language").isNotNull(), F.array(value("language"))).otherwise(F.col("languages")),
    }
    return df.select(*(out.get(c, F.col(c)).alias(c) for c in books.columns))


def with_tag(books: DataFrame, tagged: DataFrame) -> DataFrame:
    """EX8: ``tagged(lib, id, tag)`` added unless the record has them in any case."""
    new = tagged.groupBy("lib", "id").agg(F.sort_array(F.collect_set("tag")).alias("_new"))
    has = lambda t: F.exists("tags", lambda x: F.lower(x) == F.lower(t))
    fresh = F.filter(F.coalesce("_new", F.array().cast("array<string>")), lambda t: ~has(t))
    return books.join(new, ["lib", "id"], "left").withColumn("tags", F.concat("tags", fresh)).drop("_new")


def action_tags(actions: DataFrame) -> DataFrame:
    """EX8: (lib, id, tag) that the actions leave: their own, and the mark of records of which something was written."""
    updated = actions.filter("op = 'set'").select("lib", "id", F.lit(UPDATED).alias("tag"))
    return actions.filter("tag is not null").select("lib", "id", "tag").union(updated)
