"""Catalogue scans: normalised tables to records (SC1), from frames or from SQLite files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MIN_YEAR = 1400
#: Rowids that one task reads of a table.
ROWS = 100_000


class SqliteTable(DataSource):
    """spark.read.format("sqlite_table").option("path", file).option("table", name).schema(...): read-only."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        import sqlite3

        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            columns = db.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        kinds = {"INTEGER": "bigint", "REAL": "double", "BLOB": "binary"}
        return ", ".join(f"`{c[1]}` {kinds.get(c[2].upper(), 'string')}" for c in columns)

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(self.options, schema)


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema) -> None:
        self.path, self.table, self.names = options["path"], options["table"], [f.name for f in schema.fields]

    def partitions(self):
        """Ranges of rowid, ROWS wide; the path must be one that executors see."""
        import sqlite3

        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        return [InputPartition((a, a + ROWS)) for a in range(low, high + 1, ROWS)] if low is not None else [InputPartition((0, 0))]

    def read(self, partition):
        import sqlite3

        columns = ", ".join(f'"{n}"' for n in self.names)
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            yield from db.execute(f'SELECT {columns} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', partition.value)


def sqlite_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables that the file has of those named."""
    import sqlite3

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        have = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
    spark.dataSource.register(SqliteTable)
    return {n: spark.read.format("sqlite_table").option("path", path).option("table", n).load() for n in names if n in have}


def _listed(links: DataFrame | None, names: DataFrame | None, key: str, value: str = "name") -> DataFrame | None:
    """(book, values): what is linked to each book, in the order of the links."""
    if links is None or names is None:
        return None
    joined = links.select(F.col("id").alias("_ord"), "book", F.col(key).alias("_key")).join(names.select(F.col("id").alias("_key"), F.col(value).alias("_value")), "_key")
    return joined.groupBy("book").agg(F.transform(F.array_sort(F.collect_list(F.struct("_ord", "_value"))), lambda x: x["_value"]).alias("values"))


def scan(tables: dict[str, DataFrame]) -> DataFrame:
    """SC1, SC4, JN15: one row a book; missing optional tables give nulls and empty lists."""
    get = tables.get
    none = F.array().cast("array<string>")
    out = get("books")
    lists = {
        "authors": _listed(get("books_authors_link"), get("authors"), "author"),
        "publishers": _listed(get("books_publishers_link"), get("publishers"), "publisher"),
        "serieses": _listed(get("books_series_link"), get("series"), "series"),
        "tags": _listed(get("books_tags_link"), get("tags"), "tag"),
        "languages": _listed(get("books_languages_link"), get("languages"), "lang_code", "lang_code"),
    }
    for name, frame in lists.items():
        if frame is None:
            out = out.withColumn(name, none)
        else:
            out = out.join(frame.withColumnRenamed("values", name).withColumnRenamed("book", "_book"), F.col("id") == F.col("_book"), "left").drop("_book").withColumn(name, F.coalesce(name, none))
    if get("data") is not None:
        formats = get("data").groupBy(F.col("book").alias("_book")).agg(F.sort_array(F.collect_set(F.upper("format"))).alias("formats"))
        out = out.join(formats, F.col("id") == F.col("_book"), "left").drop("_book")
    else:
        out = out.withColumn("formats", none)
    if get("identifiers") is not None:
        from colophon.functions.ids import normalize_asin, normalize_isbn

        kind = F.lower("type")
        found = get("identifiers").groupBy(F.col("book").alias("_book")).agg(F.sort_array(F.collect_set(F.when(kind == "isbn", normalize_isbn("val")))).alias("isbns"), F.sort_array(F.collect_set(F.when((kind == "mobi-asin") | kind.startswith("amazon"), normalize_asin("val")))).alias("asins"))
        out = out.join(found, F.col("id") == F.col("_book"), "left").drop("_book")
    else:
        out = out.withColumn("isbns", none).withColumn("asins", none)
    year = F.year(F.try_to_timestamp("pubdate")) if "pubdate" in out.columns else F.lit(None).cast("int")
    last = lambda c: F.try_element_at(F.col(c), F.lit(-1))
    optional = [c for c in ("path", "uuid", "has_cover", "comments", "series_index", "last_modified") if c in get("books").columns]
    return out.select(
        "id", "title", F.transform("authors", lambda a: F.replace(a, F.lit("|"), F.lit(","))).alias("authors"), last("publishers").alias("publisher"), F.when(year >= MIN_YEAR, year).alias("year"),
        F.coalesce("isbns", none).alias("isbns"), F.coalesce("asins", none).alias("asins"), last("serieses").alias("series"), "tags", "languages", F.coalesce("formats", none).alias("formats"), *optional,
    )


def is_library(spark: SparkSession, path: str) -> bool:
    """SC2: a folder with a catalogue, or an empty folder; anything else isn't one."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root) or not fs.getFileStatus(root).isDirectory():
        return False
    names = {s.getPath().getName() for s in fs.listStatus(root)}
    return not names or "metadata.db" in names


def library_problems(spark: SparkSession, source: str, target: str, trash: str, longest: int = 88) -> list[str]:
    """PF9: what keeps a plan from running: libraries that aren't, a trash that is one of the others, paths that are too long."""
    found = [f"{p} isn't a library" for p in (source, target, trash) if not is_library(spark, p)]
    same = lambda a, b: a.rstrip("/").casefold() == b.rstrip("/").casefold()
    found += ["the trash is one of the libraries"] if any(same(trash, p) for p in (source, target)) else []
    return found + [f"{p} is too long" for p in dict.fromkeys((source, target, trash)) if len(p) > longest]


def tag_text(tags: str, exclude: bool = False) -> str:
    """PF5: the filter in words."""
    listed = list(dict.fromkeys(t.strip() for t in tags.split(",") if t.strip()))
    return "all records" if not listed else ("not tagged " if exclude else "tagged ") + " or ".join(f"'{t}'" for t in listed)


def tag_selects(tags: str, exclude: bool = False):
    """PF4: any (or none) of a comma-separated list, in any case; an empty list selects all."""
    wanted = sorted({t.strip().casefold() for t in tags.split(",") if t.strip()})
    if not wanted:
        return F.lit(True)
    held = F.arrays_overlap(F.transform("tags", lambda t: F.lower(t)), F.array(*map(F.lit, wanted)))
    return F.coalesce(held, F.lit(False)) != F.lit(exclude)


def tag_names(books: DataFrame) -> DataFrame:
    """SC3: the different tags, sorted without case."""
    return books.select(F.explode("tags").alias("tag")).distinct().orderBy(F.lower("tag"), "tag")
