"""What the operators share: reading tables, Arrow batches of bounded size, and cutting lineage.

Lineage is cut by writing a table below the shared folder that the session names in
``spark.checkpoint.dir``; a lost executor therefore costs a re-read and nothing more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colophon.operators.tables import forget, shared_folder, written

__all__ = ["forget", "shared_folder", "written"]

#: Bytes of text that a Python operator holds at once, however long the rows of a batch are.
BATCH_BYTES = 4 << 20

#: Characters that separate words in every contract here.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Name of the struct that holds a whole input row beside an operator's own columns, so that names can't clash.
ROW = "row"


def wrapped(df: DataFrame, *columns: Column) -> DataFrame:
    """The rows of ``df`` as one struct ROW, beside ``columns`` made from them; ``select("row.*")`` gives them back."""
    return df.select(F.struct("*").alias(ROW), *columns)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of ``column`` (or a single longer row)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if col.nbytes <= most or batch.num_rows <= 1:
            if batch.num_rows:
                yield batch
            continue
        start, held = 0, 0
        for i, n in enumerate(pc.binary_length(col).to_pylist()):
            n = n or 0
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def arrow_map(df: DataFrame, function: Callable, schema: T.StructType | str, most: int = BATCH_BYTES) -> DataFrame:
    """``mapInArrow`` over batches cut to ``most`` bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return function(slices(batches, most=most))

    return df.mapInArrow(run, schema)


def crc_mod3(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def held_out(doc_id: Column) -> Column:
    return crc_mod3(doc_id) == 1
