"""Registry of named queries over the given tables, each with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Lazy access to the Parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, keys: str = "", ints: str = "", digits: dict[str, int] | None = None, sql: str | None = None):
    """Register a query. Its output is `keys` as they are, `ints` as BIGINT and `digits` rounded.

    Sums of doubles depend on their order, hence the rounding; `sql` gets the
    same projection (adding 0.0 turns a negative zero into zero).
    """
    keys, ints, digits = keys.split(), ints.split(), digits or {}

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder)).select(
                *keys, *[F.col(c).cast("bigint").alias(c) for c in ints],
                *[(F.round(F.col(c).cast("double"), d) + F.lit(0.0)).alias(c) for c, d in digits.items()])

        QUERIES[name] = run
        if sql is not None:
            cols = [*keys, *[f"CAST({c} AS BIGINT) AS {c}" for c in ints],
                    *[f"round(CAST({c} AS DOUBLE), {d}) + 0.0 AS {c}" for c, d in digits.items()]]
            ORACLE[name] = f"SELECT {', '.join(cols)} FROM (\n{sql.strip()}\n)"
        return fn
    return add
