"""Queries over literal readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.operators.verdict import IDENTITY
from colophon.plans import answers
from colophon.queries import query, stated, values_sql
from colophon.queries.catalogue import identity

ANSWER = "struct<publisher:string,edition:int,year:int,isbns:array<string>>"


@stated(values_sql([(1, "Ace", 2, 1990, 1991, "Bantam", "x,y", "edition"), (2, "Bantam", None, 1980, 1980, "Bantam", "", "year,publisher"), (3, "Ace", None, None, None, None, "", "")], "id, publisher, edition, year, ai_year, ai_publisher, isbns, read"))
def identity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF2, PF3."""
    rows = [(1, identity(publisher="Ace", year=1990, isbns=["x"]), ("Bantam", 2, 1991, ["y"])), (2, identity(), ("Bantam", None, 1980, [])), (3, identity(publisher="Ace"), None)]
    got = answers.filled(spark.createDataFrame(rows, f"id int, identity {IDENTITY}, answer {ANSWER}"))
    return got.select("id", "identity.publisher", "identity.edition", "identity.year", "identity.ai_year", "identity.ai_publisher", F.array_join("identity.isbns", ",").alias("isbns"), F.array_join("identity.read", ",").alias("read"))


@query("""SELECT least(a.p_partkey, b.p_partkey) x, count(DISTINCT sha1(concat_ws('|', least(a.p_name, b.p_name), greatest(a.p_name, b.p_name), 'cover'))) keys FROM part a JOIN part b ON (a.p_partkey = b.p_partkey + 1 OR b.p_partkey = a.p_partkey + 1) GROUP BY x""")
def answer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AI8, JN10: one key for both orders of a pair."""
    part = spark.read.parquet(f"{sf_dir.rstrip('/')}/part.parquet").select("p_partkey", "p_name")
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    both = part.join(after, "p_partkey")
    keys = both.select(F.col("p_partkey").alias("x"), answers.pair_key(F.col("p_name"), F.col("other"), "cover").alias("k")).union(both.select("p_partkey", answers.pair_key(F.col("other"), F.col("p_name"), "cover")))
    return keys.groupBy("x").agg(F.countDistinct("k").alias("keys"))


@stated(values_sql([(1, "duplicate", 100.0), (2, None, None), (3, "unsure", 0.0)], "id, verdict, confidence", "id, verdict, confidence::DOUBLE AS confidence"))
def judge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AI3, SL8."""
    rows = [(1, 'so {"verdict": "Duplicate", "confidence": 140, "evidence": ["a"]}'), (2, '{"verdict": "maybe"}'), (3, '{"verdict": "unsure"}')]
    df = spark.createDataFrame(rows, "id int, reply string").withColumn("j", answers.judgement("reply"))
    return df.select("id", "j.verdict", "j.confidence")


ERRORS = [("blocked by content filter", "filtered"), ("maximum context length is 8192 tokens", "too long"), ("HTTP 503", "http"), ("odd", "other")]


@stated(values_sql(ERRORS, "message, kind"))
def error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AI11."""
    return spark.createDataFrame([e[:1] for e in ERRORS], "message string").withColumn("kind", answers.error_kind("message"))
