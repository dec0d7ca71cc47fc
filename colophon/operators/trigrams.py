"""Many searches at once by an inverted index of trigrams (PF22).

A text contains a search word only if it has all trigrams of it. The trigrams that the searches ask for are posted
with the texts that have them, in one pass over the texts. Each search word takes its KEEP rarest trigrams; their
postings are intersected by counting, the words of a search likewise, and what is left is verified by ``contains``. So a search reads the
postings of rare trigrams, not the texts.

A word of one or two letters stands for all trigrams of the texts that hold it, one of which must be there; texts shorter than a trigram are
posted as they are. Texts and searches are compared as they stand: fold both before.

Cases: null texts contain nothing; a search without words finds every text that isn't null; repeated words count once; repeated ids are texts of their own only
if they are told apart by the caller; a null search finds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colophon.operators.tables import bounded, written

#: Trigrams of a search word whose postings are intersected.
KEEP = 3
#: Rows of asked trigrams, or of candidates, up to which they are broadcast.
SMALL = 500_000


def trigrams(text: Column) -> Column:
    """The different trigrams of a text; a shorter text is one itself."""
    return F.array_distinct(F.when(F.char_length(text) < 3, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), F.lit(1))))


def search_words(search: Column) -> Column:
    return F.array_distinct(F.filter(F.split(search, " "), lambda w: w != ""))


def postings(texts: DataFrame, grams: DataFrame | None = None) -> DataFrame:
    """(gram, id) of ``texts(id, text)``; with ``grams(gram)``, of these only."""
    each = texts.filter("text is not null").select("id", F.explode(trigrams(F.col("text"))).alias("gram"))
    return each if grams is None else each.join(bounded(grams, SMALL), "gram")


def search(texts: DataFrame, searches: DataFrame) -> DataFrame:
    """(search_id, id): the texts of ``texts(id, text)`` that contain every word of ``searches(search_id, search)``, words being parted by spaces."""
    words = searches.filter("search is not null").select("search_id", F.explode(search_words(F.col("search"))).alias("word")).distinct()
    words = written(words, "words")
    long = words.filter(F.char_length("word") >= 3).select("word").distinct().select("word", F.explode(trigrams(F.col("word"))).alias("gram"))
    short = words.filter(F.char_length("word") < 3).select("word").distinct()
    # what short words stand for: of the different trigrams of all texts those that hold them
    spoken = postings(texts).select("gram").distinct()
    within = spoken.select("gram", F.explode(_pieces(F.col("gram"))).alias("word")).join(bounded(written(short, "short"), SMALL), "word") if short.limit(1).count() else long.limit(0)
    asked = written(long.select("word", "gram", F.lit(False).alias("any")).union(within.select("word", "gram", F.lit(True).alias("any"))), "asked")
    index = written(postings(texts, written(asked.select("gram").distinct(), "grams")), "postings")
    counts = index.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("word").orderBy("n", "gram")
    ranked = asked.filter("not any").join(counts, "gram", "left").fillna(0, ["n"]).withColumn("k", F.row_number().over(rarest)).filter(F.col("k") <= KEEP)
    chosen = written(ranked.select("word", "gram", F.count("*").over(Window.partitionBy("word")).alias("of")).union(asked.filter("any").select("word", "gram", F.lit(1).cast("bigint"))), "chosen")
    held = index.join(bounded(chosen, SMALL), "gram").groupBy("word", "id").agg(F.count("*").alias("n"), F.first("of").alias("of")).filter("n >= of").select("word", "id")
    sizes = words.groupBy("search_id").agg(F.count("*").alias("words"))
    found = words.join(held, "word").groupBy("search_id", "id").agg(F.count("*").alias("n")).join(sizes, "search_id").filter("n = words")
    lists = words.groupBy("search_id").agg(F.collect_list("word").alias("list"))
    candidates = written(found.join(lists, "search_id").select("search_id", F.col("id").alias("of"), "list"), "candidates")
    own = texts.filter("text is not null").join(bounded(candidates, SMALL), F.col("id") == F.col("of"))
    hits = own.filter(F.forall("list", lambda w: F.contains(F.col("text"), w))).select("search_id", "id")
    every = searches.filter(F.size(search_words(F.col("search"))) == 0).select("search_id").distinct()
    return hits.union(every.join(texts.filter("text is not null").select("id")) if every.limit(1).count() else hits.limit(0))


def _pieces(gram: Column) -> Column:
    """The different pieces of one and two letters of a trigram."""
    return F.array_distinct(F.filter(F.array(*(F.substring(gram, i, n) for n in (1, 2) for i in range(1, 5 - n))), lambda w: w != ""))
