"""Queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


class Tables:
    """Tables of a folder; zone-less timestamps are read as UTC."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        zoneless = [n for n, t in df.dtypes if t == "timestamp_ntz"]
        return df.withColumns({n: F.col(n).cast("timestamp") for n in zoneless}) if zoneless else df

    def rows(self, schema: str, *rows: tuple) -> DataFrame:
        """A small inline table. Times are given as text and become UTC timestamps."""
        parts = [p.strip().split(" ") for p in schema.split(",")]
        raw = ", ".join(f"{n} {'string' if t == 'timestamp' else t}" for n, t in parts)
        df = self.spark.createDataFrame(list(rows), raw)
        return df.select(*[F.col(n).cast(t).alias(n) if t == "timestamp" else F.col(n) for n, t in parts])


def us(c: str | Column) -> Column:
    return F.unix_micros(c)


def r6(c: str | Column, n: int = 6) -> Column:
    return F.round(F.col(c).cast("double") if isinstance(c, str) else c.cast("double"), n)


def day(c: str) -> Column:
    return F.date_format(F.date_trunc("day", c), "yyyy-MM-dd")
