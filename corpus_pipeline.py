"""The corpus pipeline: stages over documents, each written as Parquet and read again.

1. toxicity: documents predicted toxic go.
2. line_dedup: lines equal or similar to an earlier line go; the documents stay.
3. simhash_near_dedup: of each group of near duplicates the smallest doc_id stays.
4. mixing_sources: all documents, in the order of their slots in the Pfair schedule.
5. best_fit_packing: every piece of every document with its sequence and place.

Cases: each stage has the defined results of its operator; an empty table passes through all of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from colophon.llm import lines, mixing, packing, simhash, toxicity
from colophon.llm.common import documents, forget, shared_folder, table
from colophon.llm.queries import vocabulary


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_stage),
    ("mixing_sources", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: The first stages learn and compare in ways that SQL can't express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's output is a table in the shared folder until the next one is written."""
    df = documents(spark, sf_dir)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, df, sf_dir).write.parquet(f"{folder}/{name}")
        if k:
            forget(df)
        df = spark.read.parquet(f"{folder}/{name}")
    return df
