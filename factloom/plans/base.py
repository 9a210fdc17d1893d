"""How queries register, and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: FNV-1a of an ASCII text expression as SQL.
FNV = (
    "lpad(to_hex(list_reduce(list_prepend(14695981039346656037::UBIGINT, [ord(c)::UBIGINT FOR c IN string_split({}, '')]), "
    "lambda h, b: ((xor(h, b)::UHUGEINT * 1099511628211) % 18446744073709551616)::UBIGINT)).lower(), 16, '0')"
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir) under its name, with its SQL twin if there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
