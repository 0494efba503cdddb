"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only in local mode without such a setting (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lumenrank-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/lumenrank-{what}-{uuid.uuid4().hex}"


#: Bytes of a table for each core below which its rows are dealt out anew before work that is long for each row.
SPREAD_BYTES = 1 << 25


def spread(df: DataFrame) -> DataFrame:
    """``df``, its rows dealt out evenly if the table is small: it may be one file that one task reads, and dealing it out costs little.
    A large table comes in as many pieces as it has blocks and stays as it is. No result depends on it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as a table and read back: it is computed once however often it is used, and
    the files' sizes decide on broadcasts."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["written_to"] = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of ``written`` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.__dict__["written_to"])
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
