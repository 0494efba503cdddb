"""Reading the input tables, always through Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``name``.parquet under ``sf_dir``, which may be any path Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
