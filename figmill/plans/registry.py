"""Queries by name, each with the SQL that checks it, and tables derived by SQL that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def query(sql: str | None, **parts: str):
    """Registers a query (spark, sf_dir) -> DataFrame under its function's name; {name} in the SQL stands for a part in brackets, or a table."""

    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries named {f.__name__}")
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = written(sql, parts) if parts else sql
        return f

    return add


def written(sql: str, parts: dict[str, str]) -> str:
    """SQL with the derived tables in it as subqueries."""
    return sql.format(**{t: t for t in TABLES}, **{k: f"({written(v, {})})" for k, v in parts.items()})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a derived table; {table} in its SQL stands for a table of the data set."""
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql})
