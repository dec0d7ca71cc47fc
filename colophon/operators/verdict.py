"""Comparing a pair of identities, and deciding over a record's pairs.

An identity is a struct: title, publisher, edition, year, ai_year, ai_publisher, isbns, asins,
read (names of the fields a machine filled), series_name, series_number. Publisher equality is given
as columns (it is computed once per pair), so the verdict is one expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.functions.people import same_publisher

IDENTITY = "struct<publisher:string,edition:int,year:int,ai_year:int,ai_publisher:string,isbns:array<string>,asins:array<string>,read:array<string>,series_name:string,series_number:double>"


def with_publishers(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Adds what the publishers of the pair say: both given, read by machine, and equal."""
    pair = lambda name: (F.nullif(F.col(f"{a}.{name}"), F.lit("")), F.nullif(F.col(f"{b}.{name}"), F.lit("")))
    (ma, mb), (ra, rb) = pair("publisher"), pair("ai_publisher")
    by_machine = ra.isNotNull() & rb.isNotNull()
    pa, pb = F.when(by_machine, ra).otherwise(ma), F.when(by_machine, rb).otherwise(mb)
    return pairs.withColumn("_pa", pa).withColumn("_pb", pb).withColumn("publishers", F.when(F.col("_pa").isNotNull() & F.col("_pb").isNotNull(), same_publisher(F.col("_pa"), F.col("_pb")))).drop("_pa", "_pb")


def verdict(a: str = "a", b: str = "b", publishers: str = "publishers") -> Column:
    """DL7: struct(verdict, why, proof, year_only, incomparable) of a pair of identities."""
    at = lambda side, name: F.col(f"{side}.{name}")
    both = lambda name: at(a, name).isNotNull() & at(b, name).isNotNull()
    same_series = both("series_name") & both("series_number") & (at(a, "series_name") == at(b, "series_name")) & (at(a, "series_number") == at(b, "series_number"))
    by_machine = both("ai_year")
    ya, yb = (F.when(by_machine, at(x, "ai_year")).otherwise(at(x, "year")) for x in (a, b))
    years, editions = ya.isNotNull() & yb.isNotNull(), both("edition")
    edition_is = F.when(editions, F.when(at(a, "edition") == at(b, "edition"), "same").otherwise("other")).when(years, F.when(ya == yb, "same").otherwise("other"))
    mixed = edition_is.isNull() & (at(a, "edition").isNotNull() | ya.isNotNull()) & (at(b, "edition").isNotNull() | yb.isNotNull())
    publisher_is = F.when(F.col(publishers), "same").when(~F.col(publishers), "other")
    edition_by = F.when(editions, "edition").when(years, "year")
    has_data = lambda x: at(x, "edition").isNotNull() | at(x, "year").isNotNull() | at(x, "ai_year").isNotNull() | (F.coalesce(at(x, "publisher"), F.lit("")) != "") | (F.coalesce(at(x, "ai_publisher"), F.lit("")) != "")
    read_alike = F.array_contains(at(a, "read"), "edition") & F.array_contains(at(b, "read"), "edition") & editions & (at(a, "edition") == at(b, "edition")) & by_machine & (at(a, "ai_year") == at(b, "ai_year"))

    def out(v: str, why: Column | str, proof: bool = False, year_only: Column | None = None, incomparable: Column | None = None) -> Column:
        no = F.lit(False)
        return F.struct(F.lit(v).alias("verdict"), (F.lit(why) if isinstance(why, str) else why).alias("why"), F.lit(proof).alias("proof"), F.coalesce(no if year_only is None else year_only, no).alias("year_only"), F.coalesce(no if incomparable is None else incomparable, no).alias("incomparable"))

    edition_differs, publisher_differs = edition_is == "other", publisher_is == "other"
    nothing_compared = ~F.coalesce(edition_is == "same", F.lit(False)) & ~F.coalesce(publisher_is == "same", F.lit(False))
    return (
        F.when(F.arrays_overlap(at(a, "isbns"), at(b, "isbns")), out("duplicate", "isbn", True))
        .when(F.arrays_overlap(at(a, "asins"), at(b, "asins")), out("duplicate", "asin", True))
        .when(same_series, out("duplicate", "series", True))
        .when(edition_differs, out("distinct", edition_by, year_only=~editions & ~by_machine & ~F.coalesce(publisher_differs, F.lit(False))))
        .when(publisher_differs, out("distinct", "publisher"))
        .when((edition_is == "same") & (publisher_is == "same"), out("duplicate", F.concat(edition_by, F.lit("+publisher"))))
        .when(read_alike, out("duplicate", "read edition+year"))
        .otherwise(out("unknown", F.concat_ws("+", F.when(edition_is.isNull(), F.when(mixed, "edition mixed").otherwise("edition missing")), F.when(publisher_is.isNull(), "publisher missing")), incomparable=mixed | (nothing_compared & has_data(a) & has_data(b))))
    )


def decide(pairs: DataFrame, by: list[str]) -> DataFrame:
    """AG7: over a record's pairs (``ord``, ``v`` a verdict): the first duplicate, else unknown, else distinct."""
    of = lambda what: F.min(F.when(F.col("v.verdict") == what, F.struct("ord", "v.why", "v.proof")))
    reasons = lambda what: F.array_join(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(F.col("v.verdict") == what, F.struct("ord", "v.why")))), lambda x: x["why"])), "; ")
    df = pairs.groupBy(*by).agg(of("duplicate").alias("dup"), F.count_if(F.col("v.verdict") == "unknown").alias("unknown"), reasons("unknown").alias("unknown_why"), reasons("distinct").alias("distinct_why"))
    return df.select(
        *by,
        F.when(F.col("dup").isNotNull(), "duplicate").when(F.col("unknown") > 0, "unknown").otherwise("distinct").alias("verdict"),
        F.when(F.col("dup").isNotNull(), F.col("dup.why")).when(F.col("unknown") > 0, F.col("unknown_why")).otherwise(F.col("distinct_why")).alias("why"),
        F.col("dup.ord").alias("match_ord"),
        F.coalesce(F.col("dup.proof"), F.lit(False)).alias("proof"),
    )


def by_cover(kind: Column, cover: Column, longer: Column, always: Column) -> Column:
    """DL11: what a cover verdict makes of a pair of the given kind, or null where it stays as it is."""
    return (
        F.when((kind == "open") & (cover == "same"), "duplicate, to review")
        .when((kind == "open") & (cover == "unclear") & ~longer, "duplicate without edition, to review")
        .when((kind == "incomparable") & (cover == "same"), "duplicate, to review")
        .when((kind == "weak") & (cover == "same"), "duplicate, overriding, to review")
        .when((kind == "weak") & (cover == "different"), "distinct")
        .when((kind == "different") & always & (cover == "same"), "duplicate, overriding, to review")
        .when((kind == "different") & always, "distinct")
    )


def cover_verdict(on: Column, a: Column, b: Column, odd_a: Column, odd_b: Column, generic: Column, answer: Column) -> Column:
    """IM5: same, different, unclear or skipped, by what is known of two covers.

    ``a`` and ``b`` are digests of the cover files (null: none), ``odd_*`` say that a cover is a page of text, ``generic`` that either is a
    placeholder, ``answer`` is what a reader of images said (null: none was asked).
    """
    both = a.isNotNull() & b.isNotNull()
    return (
        F.when(~on, "skipped")
        .when(both & ~generic & (a == b), "same")
        .when(answer.isNull(), "skipped")
        .when(~both | generic | odd_a | odd_b, "unclear")
        .when(answer.isin("same", "different"), answer)
        .otherwise("unclear")
    )


def cover_kind(verdict_: Column, incomparable: Column, year_only: Column, recheck: Column, always: Column) -> Column:
    """DL10, DL11: what the metadata leave open about a pair, or null."""
    return F.when(verdict_ == "unknown", F.when(incomparable, "incomparable").otherwise("open")).when((verdict_ == "distinct") & year_only & recheck, "weak").when((verdict_ == "distinct") & always, "different")
