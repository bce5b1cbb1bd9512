"""SQL text as a request: all tables are views of the session, and Catalyst plans it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def register(spark: SparkSession, sf_dir: str) -> None:
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.sql(text)


def plain_command(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The result of one statement, every value as a string; a text of several statements is an error."""
    rows = sql(spark, sf_dir, text)
    return rows.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns])
