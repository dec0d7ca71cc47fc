"""Written tables: lineage cut by files in the shared folder that the session names."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of Parquet up to which a counted table may be broadcast.
BROADCAST_BYTES = 64 << 20
#: Bytes of Parquet from which a written table isn't to be broadcast by Spark's own choice.
EXCHANGED_BYTES = 256 << 10


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one is made up only in local mode and where the session has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = given.get() if given.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="colophon-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def exchanged(df: DataFrame) -> DataFrame:
    """``df`` marked so that its next join exchanges both sides, if these meet by equal columns and none is marked for broadcast.

    Spark takes a side for small by the compressed bytes of its files or shuffle blocks, and doesn't count what ``explode`` adds. Rows that
    repeat compress to a fiftieth or less, so the driver would hold tables of millions of rows in order to broadcast them.
    """
    return df.hint("merge")


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, its lineage cut, safe from lost executors, exchanged by joins unless it is small."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    return out if size < EXCHANGED_BYTES else exchanged(out)


def _folders(df: DataFrame) -> list:
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(path) for path in {f.rpartition("/")[0] for f in df.inputFiles()}]
    return [(p.getFileSystem(conf), p) for p in paths]


def forget(df: DataFrame) -> None:
    """Deletes the files behind a frame that ``written`` returned."""
    for system, path in _folders(df):
        system.delete(path, True)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """A frame over written tables, marked for broadcast if these are small in bytes and in rows."""
    size = sum(system.getContentSummary(path).getLength() for system, path in _folders(df))
    return F.broadcast(df) if size <= BROADCAST_BYTES and df.count() <= rows else df


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that are no longer used; it does so when their objects are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
