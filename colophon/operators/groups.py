"""Aggregates over the whole catalogue: placeholders, collections, support, and the best copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACEHOLDER, COLLECTION = 3, 20
#: Formats from the best to the worst; all others come after.
FORMAT_RANK = [["EPUB"], ["MOBI"], ["AZW", "AZW3"]]


def placeholders(df: DataFrame, *on: str, title: str = "title_key", author: str = "authors_key") -> DataFrame:
    """AG1: values of ``on`` that stand for at least three titles and three sets of authors, and their rows."""
    return df.groupBy(*on).agg(F.countDistinct(title).alias("titles"), F.countDistinct(author).alias("authors"), F.count("*").alias("rows")).filter((F.col("titles") >= PLACEHOLDER) & (F.col("authors") >= PLACEHOLDER))


def collection_words(df: DataFrame, series: str = "series_key", least: int = COLLECTION) -> DataFrame:
    """AG5: different words of the series that hold at least so many records."""
    many = df.filter(F.col(series).isNotNull() & (F.col(series) != "")).groupBy(series).count().filter(F.col("count") >= least)
    return many.select(F.explode(F.split(series, " ")).alias("word")).distinct()


def format_rank(formats: Column) -> Column:
    """SO4: the rank (from 0) of the best of an array of format names."""
    out = F.lit(len(FORMAT_RANK))
    for rank, names in reversed(list(enumerate(FORMAT_RANK))):
        out = F.when(F.arrays_overlap(formats, F.array(*map(F.lit, names))), F.lit(rank)).otherwise(out)
    return out


def richness(df_columns: dict[str, Column]) -> Column:
    """AG8: how many of the given conditions hold."""
    return sum((F.coalesce(c.cast("int"), F.lit(0)) for c in df_columns.values()), F.lit(0))


def best_copy(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """WN1, WN2: ``rank`` within the group and ``kept``, the id of the first."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).withColumn("kept", F.first("id").over(w))


def newest(df: DataFrame, group: list[str], order: list[Column], keep: int) -> DataFrame:
    """WN5: the first ``keep`` rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= keep)


def author_support(books: DataFrame) -> DataFrame:
    """AG6: (lib, kind, name, n): how many books each author key has (``book``), and of how many author keys each part of a name is one (``person``).

    ``books(lib, id, authors_key)``: the keys of each book's authors.
    """
    each = books.select("lib", "id", F.explode("authors_key").alias("author")).distinct()
    own = each.groupBy("lib", "author").agg(F.count("*").alias("n"))
    parts = own.select("lib", "author", F.explode(F.array_distinct(F.split("author", " "))).alias("part")).groupBy("lib", "part").agg(F.count("*").alias("n"))
    return own.select("lib", F.lit("book").alias("kind"), F.col("author").alias("name"), "n").union(parts.select("lib", F.lit("person").alias("kind"), F.col("part").alias("name"), "n"))


def first_of_each(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """AG16: the first row of each key, with all its columns; an aggregate, so that a hot key is reduced before it is exchanged."""
    place, row = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order))), F.struct("*")
    first = df.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), row.alias("row"), place.alias("place"))
    return first.groupBy(*(f"k{i}" for i in range(len(keys)))).agg(F.min_by("row", "place").alias("row")).select("row.*")
