"""A decorator that registers a query of a module with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def registry():
    queries: dict = {}
    sql: dict = {}

    def query(oracle: str | None = None):
        def register(f):
            queries[f.__name__] = f
            if oracle:
                sql[f.__name__] = oracle
            return f

        return register

    return queries, sql, query


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
