"""Where queries and the SQL of the same meaning are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLE_SQL: dict = {}
#: Queries on made-up rows, and their SQL: tests run them, the driver's list doesn't have them.
FIXTURES: dict = {}
FIXTURE_SQL: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def fixture(sql: str | None = None):
    def add(fn):
        FIXTURES[fn.__name__] = fn
        if sql:
            FIXTURE_SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def values(rows: list[tuple], names: str) -> str:
    """SQL of a constant table."""
    word = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(word, r)) + ')' for r in rows)}) v({names})"
