"""Query registry: a Spark callable and, where SQL can say it, the equivalent DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import new_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy readers of the tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.schemas: dict[str, T.StructType] = {}
        self.stored: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getitem__(self, name: str) -> DataFrame:
        """A fresh frame per use; the file footer is only read for the first one."""
        if name not in self.schemas:
            self.schemas[name] = self.spark.read.parquet(self.path(name)).schema
        return self.spark.read.schema(self.schemas[name]).parquet(self.path(name))

    def once(self, make: Callable[[Tables], DataFrame]) -> DataFrame:
        """``make(self)`` as a written table, for queries that read it several times."""
        if make.__name__ not in self.stored:
            df = make(self)
            path = new_dir(self.spark, make.__name__)
            df.write.parquet(path)
            self.stored[make.__name__] = self.spark.read.schema(df.schema).parquet(path)
        return self.stored[make.__name__]


def tidy(df: DataFrame, dp: int = 8) -> DataFrame:
    """Comparable output: rounded doubles without negative zero, 64-bit integers."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), dp) + 0.0
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def tidy_sql(sql: str, doubles: str, dp: int = 8) -> str:
    names = doubles.split()
    if not names:
        return sql
    fixed = ", ".join(f"round(CAST({n} AS DOUBLE), {dp}) + 0.0 AS {n}" for n in names)
    return f"SELECT * REPLACE ({fixed}) FROM ({sql}) _t"


def query(name: str, sql: str | None = None, doubles: str = "", dp: int = 8, views: str = ""):
    """Register ``name``; ``views`` is a WITH list the SQL is written against."""

    def wrap(fn):
        QUERIES[name] = lambda spark, folder: tidy(fn(Tables(spark, folder)), dp)
        if sql is not None:
            body = tidy_sql(sql, doubles, dp)
            ORACLES[name] = f"WITH {views}\n{body}" if views else body
        return fn

    return wrap


__all__ = ["ORACLES", "QUERIES", "Tables", "query", "tidy", "tidy_sql"]
