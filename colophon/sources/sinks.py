"""Sinks and side inputs: plan and review reports, saved tables with retention, JSON inputs, known libraries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame) -> DataFrame:
    """Arrays become text joined by " & ", so that a row fits a CSV line."""
    return df.select(*(F.concat_ws(" & ", c).alias(c) if isinstance(t.dataType, T.ArrayType) else F.col(c) for c, t in ((f.name, f) for f in df.schema.fields)))


def write_csv(df: DataFrame, path: str) -> None:
    """A report with a header, quoted where needed, whose first column name starts with a byte order mark; as many files as the frame has partitions."""
    out = flat(df)
    out.withColumnRenamed(out.columns[0], "\ufeff" + out.columns[0]).write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def plan_report(plan: DataFrame, books: DataFrame) -> DataFrame:
    """SK1: the 18 columns of a plan report, a row for each decision.

    ``plan`` has PLAN's columns and ``add``, ``manual``, ``status``; ``books`` is the catalogue with ``identity`` (features).
    """
    yes = lambda c: F.when(F.coalesce(c, F.lit(False)), "yes").otherwise("")
    list_ = lambda c: F.array_join(F.array_sort(F.coalesce(c, F.array().cast("array<string>"))), ",")
    label = F.concat(F.lit("#"), F.col("id").cast("string"), F.lit(" "), F.col("title"), F.lit(" - "), F.array_join("authors", " & "))
    own = books.filter("side = 'source'").select("lib", "id", "title", "authors", "identity", "broken", "foreign")
    theirs = books.select("lib", F.col("id").alias("match"), F.col("side").alias("match_side"), label.alias("label"))
    df = plan.join(own, ["lib", "id"]).join(theirs, ["lib", "match", "match_side"], "left")
    i = lambda n: F.col(f"identity.{n}")
    none = F.array().cast("array<string>")
    takes_out = (F.size(F.coalesce("broken", none)) > 0) & (F.col("action") != "trash")
    return df.select(
        F.col("id").alias("source_id"), yes(F.col("selected") & (F.col("action") != "leave")).alias("checked"), yes(F.col("manual")).alias("manual"), "title", F.array_join("authors", " & ").alias("authors"), "action", "reason",
        F.coalesce("label", F.lit("")).alias("match"), F.coalesce("add", F.lit("")).alias("add_formats"), list_(F.concat(F.coalesce("broken", none), F.coalesce("foreign", none))).alias("unreadable_formats"), yes(takes_out).alias("unreadable_to_trash"),
        F.coalesce(i("publisher"), F.lit("")).alias("publisher"), F.coalesce(i("edition").cast("string"), F.lit("")).alias("edition"), F.coalesce(i("year").cast("string"), F.lit("")).alias("year"), list_(i("isbns")).alias("isbn"),
        yes(F.size(i("read")) > 0).alias("ai_used"), list_(i("read")).alias("ai_fields"), F.coalesce("status", F.lit("")).alias("status"),
    )


def review_report(values: DataFrame, proposals: DataFrame, decided: DataFrame) -> DataFrame:
    """SK2: a row for each reviewed record: seven fields as they are, as read and as proposed, what was left out, cover, action and note.

    ``values`` is ``edit.field_values``, ``decided`` has lib, id, cover, action, note.
    """
    from colophon.plans.edit import FIELDS

    at = lambda name, column: F.coalesce(F.max(F.when(F.col("field") == name, F.col(column))), F.lit(""))
    now = values.groupBy("lib", "id").agg(*(at(n, "current").alias(f"now_{n}") for n in FIELDS), *(at(n, "read").alias(f"read_{n}") for n in FIELDS))
    left = F.array_join(F.sort_array(F.collect_list(F.when(F.col("doubt").isNotNull(), F.concat("field", F.lit(": "), "doubt")))), "; ")
    new = proposals.groupBy("lib", "id").agg(*(at(n, "proposed").alias(f"new_{n}") for n in FIELDS), left.alias("left_out"))
    df = decided.join(now, ["lib", "id"]).join(new, ["lib", "id"], "left")
    filled = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return df.select("lib", F.col("id").alias("book_id"), *(f"now_{n}" for n in FIELDS), *(f"read_{n}" for n in FIELDS), *(filled(f"new_{n}") for n in FIELDS), filled("left_out"), filled("cover"), "action", filled("note"))


def journal_rows(done: DataFrame, books: DataFrame, after: DataFrame) -> DataFrame:
    """SK3: the twelve columns of the journal, a row for each record that was acted on.

    ``done(lib, id, time, action, ok, result, why, match)``; ``books`` and ``after`` hold the records before and after.
    """
    show = lambda: F.concat_ws(" | ", "title", F.array_join("authors", " & "), F.array_join(F.array_sort("formats"), ","))
    was = books.filter("side = 'source'").select("lib", "id", "title", F.array_join("authors", " & ").alias("authors"), show().alias("before"))
    now = after.select("lib", "id", show().alias("after"))
    df = done.join(was, ["lib", "id"], "left").join(now, ["lib", "id"], "left")
    return df.select("time", F.col("lib").alias("library"), F.col("id").alias("book_id"), "title", "authors", "action", "ok", "result", "why", F.col("match").cast("string").alias("match"), "before", "after")


def run_log(spark: SparkSession, folder: str, rows: DataFrame, most_bytes: int = 5 << 20, keep: int = 3) -> None:
    """SK8: JSON lines appended to the newest part of a log; a part that is full is followed by the next, and only ``keep`` full ones stay."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted(int(s.getPath().getName()) for s in fs.listStatus(root) if s.getPath().getName().isdigit()) if fs.exists(root) else []
    path = lambda n: spark._jvm.org.apache.hadoop.fs.Path(root, str(n))
    now = parts[-1] if parts else 0
    if parts and fs.getContentSummary(path(now)).getLength() >= most_bytes:
        now += 1
    rows.write.mode("append").json(f"{folder}/{now}")
    for n in parts:
        if n < now - keep:
            fs.delete(path(n), True)


def save_version(df: DataFrame, folder: str, keep: int) -> int:
    """SK4, SK5: the next version of a table; all but the newest ``keep`` complete ones go. A version without its success mark is no version."""
    from colophon.streaming.facts import newest

    spark = df.sparkSession
    number = newest(spark, folder)[0] + 1
    df.write.mode("overwrite").parquet(f"{folder}/{number}")
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for s in fs.listStatus(root):
        name = s.getPath().getName()
        if name.isdigit() and int(name) <= number - keep:
            fs.delete(s.getPath(), True)
    return number


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SC18: JSON lines with a schema; missing files and damaged lines give nothing."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def known_libraries(uses: DataFrame) -> DataFrame:
    """SC19: ``uses(path, n)`` merged without case, the most used first."""
    return uses.groupBy(F.lower("path").alias("_key")).agg(F.min("path").alias("path"), F.sum("n").alias("n")).orderBy(F.desc("n"), "path").drop("_key")


def console_lines(plan: DataFrame) -> DataFrame:
    """SK9."""
    return plan.select(F.format_string("%-6s #%d %s / %s", F.upper("action"), "id", "title", "why").alias("line"))
