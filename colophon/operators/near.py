"""Words one edit apart, by their deletion neighbourhoods (NM4, NM5, JN5).

Two words of one length that differ in one letter are equal without that letter, taken out at the same place; a word that has one letter
more equals the other without it. So every word is posted with each of its letters taken out, together with the place, and words meet
on these postings: longer ones with the whole of shorter ones, equally long ones with each other. What meets is one edit
apart, and nothing else meets: the join makes no candidates beyond its result, whatever words are frequent.

Words are joined within ``on`` (other words of a name, a title): equal rows are to be made distinct before, and brought back by a join.

Cases: null words meet nothing; equal words aren't a pair; an empty word is one edit from every single letter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.functions.people import names_nearly_equal, similar_author_key
from colophon.functions.titles import MIN_TYPO
from colophon.operators.tables import exchanged


def cuts(word: Column) -> Column:
    """The word without each of its letters: array of (at, rest)."""
    places = F.when(F.char_length(word) > 0, F.sequence(F.lit(1), F.char_length(word))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.char_length(word))).alias("rest")))


def near_words(left: DataFrame, right: DataFrame, on: list[str], word: str = "word") -> DataFrame:
    """Pairs of rows ``x`` of left and ``y`` of right (structs) whose words are one edit apart, with equal values of ``on``; each pair once for each edit between them."""
    keys = [f"k{i}" for i in range(len(on))]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.struct("*").alias(name), *(F.col(c).alias(k) for c, k in zip(on, keys, strict=True)), F.col(word).alias("w"))

    x, y = side(left, "x"), side(right, "y")

    def cut(df: DataFrame) -> DataFrame:
        return df.withColumn("c", F.explode(cuts(F.col("w")))).select("*", F.col("c.at").alias("at"), F.col("c.rest").alias("rest")).drop("c")

    def shorter(df: DataFrame) -> DataFrame:
        """Each way to take one letter out, once."""
        return df.withColumn("rest", F.explode(F.array_distinct(F.transform(cuts(F.col("w")), lambda c: c["rest"])))).drop("w")

    changed = exchanged(cut(x)).withColumnRenamed("w", "v").join(cut(y), [*keys, "at", "rest"]).filter(F.col("v") != F.col("w")).select("x", "y")
    added = exchanged(x).withColumnRenamed("w", "rest").join(shorter(y), [*keys, "rest"]).select("x", "y")
    dropped = exchanged(shorter(x)).join(y.withColumnRenamed("w", "rest"), [*keys, "rest"]).select("x", "y")
    return changed.union(added).union(dropped)


def one_edit_pairs(words: DataFrame, word: str = "word") -> DataFrame:
    """NM4: (a, b) with a < b of different words of the table that are one edit apart."""
    distinct = words.select(F.col(word).alias("word")).filter("word is not null").distinct()
    return near_words(distinct, distinct, []).select(F.col("x.word").alias("a"), F.col("y.word").alias("b")).filter("a < b")


def name_parts(df: DataFrame, author: str = "author") -> DataFrame:
    """Each row with each long part of its author's name: ``word``, and the other parts as ``others``."""
    key = similar_author_key(F.col(author))
    keyed = df.withColumn("key", key).withColumn("size", F.size("key"))
    each = keyed.select("*", F.posexplode("key").alias("place", "word")).filter(F.char_length("word") >= MIN_TYPO)
    others = F.array_join(F.filter("key", lambda w, i: i != F.col("place")), " ")
    return each.withColumn("others", others).drop("key", "place")


def near_names(left: DataFrame, right: DataFrame, on: list[str], author: str = "author") -> DataFrame:
    """NM5: pairs of rows ``x`` and ``y`` with equal values of ``on`` and names that differ by one letter of one long part."""
    met = near_words(name_parts(left, author), name_parts(right, author), [*on, "others", "size"])
    return met.filter(names_nearly_equal(F.col(f"x.{author}"), F.col(f"y.{author}")))
