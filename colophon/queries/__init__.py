"""The queries of the library, each with SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with the SQL that it is held against."""

    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


#: Small stated cases of the rules, which tests hold against their results; the queries of the same names run over tables.
STATED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def stated(sql: str):
    """Keeps a function over stated rows, with the rows that it must give, for the tests."""

    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        STATED[function.__name__] = (function, sql)
        return function

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of a table over as many tasks as a shuffle has: a file of a few MB has a million short rows, whose keys one or two tasks would compute."""
    return read(spark, sf_dir, name).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(literal, value)) + "]"
    return "'" + str(value).replace("'", "''") + "'"


def values_sql(rows: list[tuple], names: str, casts: str = "*") -> str:
    """A query of literal rows; ``casts`` are its select items."""
    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"SELECT {casts} FROM (VALUES {body}) t({names})"


from colophon.queries import answers, catalogue, documents, logs, scalars, shelves, templates, upkeep  # noqa: E402, F401
