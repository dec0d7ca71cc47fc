"""Machine readings as a table of facts: keys, requests, joins, and what they fill in.

No query calls a model. Readings are a table ``answers(key, ...)``; records without one are what is still to be asked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.functions.text import col


def file_key(path: Column, size: Column, modified: Column, part: str) -> Column:
    """AI8, JN9: a reading belongs to a file as it was and to a part of it."""
    return F.sha1(F.concat_ws("|", path, size.cast("string"), modified.cast("string"), F.lit(part)).cast("binary"))


def pair_key(a: Column, b: Column, part: str) -> Column:
    """AI8, JN10: the same whichever side comes first."""
    return F.sha1(F.concat_ws("|", F.least(a, b), F.greatest(a, b), F.lit(part)).cast("binary"))


def with_answers(df: DataFrame, answers: DataFrame, key: str = "key") -> DataFrame:
    """JN9: rows with their reading in ``answer``, null where there is none."""
    return df.join(answers.select(key, F.struct(*[c for c in answers.columns if c != key]).alias("answer")), key, "left")


def to_ask(df: DataFrame, answers: DataFrame, key: str = "key") -> DataFrame:
    """The rows that no answer covers."""
    return df.join(answers.select(key), key, "left_anti")


def needs_edition(identity: str = "identity") -> Column:
    """PF3: neither an edition nor a year, or no publisher."""
    at = lambda n: F.col(f"{identity}.{n}")
    return (at("edition").isNull() & at("year").isNull()) | (F.coalesce(at("publisher"), F.lit("")) == "")


def needs_machine_facts(identity: str = "identity") -> Column:
    """PF3: no year or no publisher that a machine has read."""
    at = lambda n: F.col(f"{identity}.{n}")
    return at("ai_year").isNull() | (F.coalesce(at("ai_publisher"), F.lit("")) == "")


def trimmed(items: Column, most: int = 8, chars: int = 300) -> Column:
    """SO3: the first ``most`` items that say something, each cut to ``chars`` characters."""
    said = F.filter(items, lambda x: F.coalesce(F.btrim(x), F.lit("")) != "")
    return F.transform(F.slice(said, 1, most), lambda x: F.substring(F.btrim(x), 1, chars))


def filled(df: DataFrame) -> DataFrame:
    """PF2: missing fields from ``answer(publisher, edition, year, isbns)``; machine year and publisher are kept beside the record's."""
    i, a = (lambda n: F.col(f"identity.{n}")), (lambda n: F.col(f"answer.{n}"))
    read = F.array_compact(F.array(F.when(i("edition").isNull() & a("edition").isNotNull(), "edition"), F.when(i("year").isNull() & a("year").isNotNull(), "year"), F.when(i("publisher").isNull() & a("publisher").isNotNull(), "publisher")))
    none = F.array().cast("array<string>")
    out = F.col("identity").withField("edition", F.coalesce(i("edition"), a("edition"))).withField("year", F.coalesce(i("year"), a("year"))).withField("publisher", F.coalesce(i("publisher"), a("publisher")))
    out = out.withField("ai_year", F.coalesce(a("year"), i("ai_year"))).withField("ai_publisher", F.coalesce(a("publisher"), i("ai_publisher")))
    out = out.withField("isbns", F.array_union(F.coalesce(i("isbns"), none), F.coalesce(a("isbns"), none))).withField("read", F.array_union(F.coalesce(i("read"), none), read))
    return df.withColumn("identity", out)


def request(df: DataFrame) -> DataFrame:
    """AI7: the JSON body of a question about two records, with at most 20,000 and 5,000 characters of each end of the texts."""
    ends = lambda c: F.struct(F.substring(c, 1, 20_000).alias("start"), F.right(col(c), F.lit(5_000)).alias("end"))
    return df.withColumn("request", F.to_json(F.struct("a", "b", ends("text_a").alias("pages_a"), ends("text_b").alias("pages_b"))))


def judgement(reply: Column | str) -> Column:
    """AI3: verdict and confidence of a reply; null if the verdict is none of the three."""
    data = F.from_json(F.regexp_extract(col(reply), r"(?s)(\{.*\})", 1), "verdict string, confidence double, evidence array<string>")
    verdict = F.lower(F.btrim(data["verdict"]))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(data["confidence"], F.lit(0.0))))
    return F.when(verdict.isin("duplicate", "different", "unsure"), F.struct(verdict.alias("verdict"), confidence.alias("confidence"), F.slice(F.coalesce(data["evidence"], F.array().cast("array<string>")), 1, 8).alias("evidence")))


def error_kind(message: Column | str) -> Column:
    """AI11: why a call failed."""
    m = F.lower(col(message))
    return F.when(m.rlike("content.?filter|content management policy|safety"), "filtered").when(m.rlike("context.?length|too long|maximum.*tokens|too many tokens"), "too long").when(m.rlike(r"\bhttp\b|\b[45]\d\d\b|connection|timed? ?out"), "http").otherwise("other")
