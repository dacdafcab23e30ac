"""The query catalogue: every query by name, with the DuckDB SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of short rows that much is worked out of, dealt to all cores: millions of them may be in one split of the file."""
    return t(spark, sf_dir, name).repartition(4 * spark.sparkContext.defaultParallelism)


def seconds_exact(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000


def sql_text(value: object) -> str:
    """A value as SQL."""
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, int | float) else "'" + str(value).replace("'", "''") + "'"


def sql_values(rows: list[tuple]) -> str:
    return ",".join("(" + ",".join(map(sql_text, r)) + ")" for r in rows)
