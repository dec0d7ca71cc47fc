"""The feature table of a catalogue: keys, identity and rank of each record, computed once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.functions import people, text, titles
from colophon.functions.ids import normalize_asin, normalize_isbn
from colophon.operators.blocking import swapped
from colophon.operators.groups import format_rank, placeholders
from colophon.operators.tables import exchanged, forget, written

#: What a catalogue's records are. ``lib`` tells independent pairs of libraries apart, ``side`` is source or target.
#: ``text_lang`` and ``text_chars`` are read from the text (SC16), ``cover`` is the cover file's digest, ``broken`` formats open
#: nowhere and ``foreign`` ones may open in another program (TX16).
BOOKS = "lib string, side string, id bigint, title string, authors array<string>, publisher string, year int, isbns array<string>, asins array<string>, series string, series_number double, tags array<string>, languages array<string>, formats array<string>, has_cover boolean, comments string, text_id bigint, digest string, ai_year int, ai_publisher string, ai_edition int, file_title string, text_lang string, text_chars bigint, cover string, page_cover boolean, broken array<string>, foreign array<string>"


def features(books: DataFrame, same_series: bool = False) -> DataFrame:
    """PF1, AG8, SO4 and the keys NM2, NM3, ST8, ST9; unknown titles and authors have empty keys."""
    known = lambda c: F.when(~text.is_unknown(c), F.col(c))
    none = F.array().cast("array<string>")
    # PF8: decided on the formats that open
    books = books.withColumn("all_formats", F.col("formats")).withColumn("formats", F.array_except("formats", F.concat(F.coalesce("broken", none), F.coalesce("foreign", none))))
    df = books.withColumn("title_key", F.coalesce(titles.title_key(known("title")), F.lit("")))
    df = df.withColumn("authors_key", F.coalesce(people.authors_key("authors"), F.array().cast("array<string>"))).withColumn("similar_keys", F.coalesce(people.similar_authors_keys("authors"), F.array().cast("array<string>")))
    valid = lambda c, rule: F.sort_array(F.array_distinct(F.array_compact(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), rule))))
    df = df.withColumn("isbns", valid("isbns", normalize_isbn)).withColumn("asins", valid("asins", normalize_asin))
    usable = F.col("series").isNotNull() & F.col("series_number").isNotNull() & ~F.col("series_number").isin(0.0, 1.0)
    series_key = F.nullif(titles.series_key("series"), F.lit(""))
    df = df.withColumn("series_key", F.when(usable & F.lit(same_series), series_key)).withColumn("is_file_name", titles.looks_like_file_name(F.coalesce("title", F.lit(""))))
    filled = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    richness = F.size("all_formats") + filled(F.col("has_cover")) + filled(F.btrim("comments") != "") + filled(F.col("publisher") != "") + F.col("year").isNotNull().cast("int") + F.size("isbns")
    df = df.withColumn("rank", format_rank(F.col("formats"))).withColumn("richness", richness)
    edition = titles.edition_number("title")
    identity = F.struct(
        known("publisher").alias("publisher"), F.coalesce(edition, "ai_edition").alias("edition"), F.col("year"), F.col("ai_year"), F.col("ai_publisher"), F.col("isbns"), F.col("asins"),
        F.array_compact(F.array(F.when(edition.isNull() & F.col("ai_edition").isNotNull(), "edition"), F.when(F.col("ai_year").isNotNull(), "year"), F.when(F.col("ai_publisher").isNotNull(), "publisher"))).alias("read"),
        F.col("series_key").alias("series_name"), F.when(F.col("series_key").isNotNull(), F.col("series_number")).alias("series_number"),
    )
    return df.withColumn("identity", identity)


def without_junk_isbns(feats: DataFrame) -> DataFrame:
    """AG2: drops ISBNs that three titles and three sets of authors share. ``feats`` should be a written table; without such ISBNs it is given back as it is."""
    each = feats.select("lib", "side", "id", "title_key", F.array_join("authors_key", "|").alias("akey"), F.explode("isbns").alias("isbn"))
    junk = written(placeholders(each, "lib", "isbn", author="akey").select("lib", "isbn"), "isbns")
    if not junk.limit(1).count():
        forget(junk)
        return feats
    own = exchanged(each).join(junk, ["lib", "isbn"], "left_semi").groupBy("lib", "side", "id").agg(F.collect_set("isbn").alias("_junk"))
    kept = F.array_except("isbns", F.coalesce("_junk", F.array().cast("array<string>")))
    df = exchanged(feats).join(own, ["lib", "side", "id"], "left").withColumn("isbns", kept).drop("_junk")
    return df.withColumn("identity", F.col("identity").withField("isbns", F.col("isbns")))


def put_right(books: DataFrame) -> DataFrame:
    """DL1, PF10: swapped records with title and authors in each other's place, and ``swapped`` for all records."""
    key = books.select("*", titles.title_key(F.coalesce("title", F.lit(""))).alias("title_key"), (F.col("id") * 2 + (F.col("side") == "target").cast("int")).alias("_key"))
    found = swapped(key.select("lib", F.col("_key").alias("id"), "title", "title_key", "authors")).select("lib", F.col("id").alias("_key"), F.lit(True).alias("_swap"))
    df = exchanged(key).join(found, ["lib", "_key"], "left").withColumn("swapped", F.coalesce("_swap", F.lit(False)) & (F.col("side") == "source"))
    title, authors = F.array_join("authors", " & "), F.array("title")
    df = df.withColumn("_title", F.when(F.col("swapped"), title).otherwise(F.col("title"))).withColumn("authors", F.when(F.col("swapped"), authors).otherwise(F.col("authors")))
    return df.withColumn("title", F.col("_title")).select(*books.columns, "swapped")
