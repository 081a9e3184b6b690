"""Registration of queries and their independent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Tables of a directory by name: ``t.orders`` reads orders.parquet."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str, *names: str, args: dict | None = None) -> DataFrame:
        """Spark SQL over the named tables, bound as ``{name}`` so that no view is left behind."""
        return self.spark.sql(text, args=args, **{n: getattr(self, n) for n in names})


def query(oracle: str | None):
    """Register ``fn(tables)`` under its name, with the SQL that must give the same rows."""

    def register(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLE[fn.__name__] = oracle
        return fn

    return register


def money(column) -> F.Column:
    """Exact sum of a double with two decimals: independent of the order of addition."""
    return F.sum(F.col(column).cast("decimal(18,4)")).cast("double")
