"""Registry of queries over the driver's tables and of the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register f(t) where t(name) reads a table."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda table: read(spark, sf_dir, table))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add
