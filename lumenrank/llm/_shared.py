"""Intermediate tables in the folder that driver and executors share, and ordered ranges."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only in local mode without such a setting (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lumenrank-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/lumenrank-{what}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark reads it by."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + full[len("file:") :] if full.startswith("file:/") and not full.startswith("file://") else full


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores after it what no column of ``df`` is called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Paths that ``materialize`` wrote to."""

    def __init__(self):
        self.paths: set[str] = set()

    def clear(self, spark: SparkSession, but: DataFrame | None = None) -> None:
        """Delete them, except the one that ``but`` was read from."""
        kept = {_path_of(but)} & self.paths
        for path in self.paths - kept:
            _delete(spark, path)
        self.paths = kept


_OPEN: list[Scratch] = []


@contextlib.contextmanager
def scratch() -> Iterator[Scratch]:
    """Collects what is written inside, to be deleted when nothing reads it any more."""
    made = Scratch()
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN.remove(made)


def _path_of(df: DataFrame | None) -> str | None:
    return None if df is None else df.__dict__.get("written_to")


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and nothing reads any more."""
    path = _path_of(df)
    if path:
        _delete(df.sparkSession, path)
        for made in _OPEN:
            made.paths.discard(path)


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there,
    and the file sizes give Catalyst a true bound for its broadcast decision."""
    spark = df.sparkSession
    path = new_path(spark, what)
    for made in _OPEN:
        made.paths.add(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["written_to"] = path
    return out


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def listed(values: list[int | None]) -> Column:
    """A constant array of longs in one expression, however many there are."""
    return F.split(F.lit(",".join("" if v is None else str(v) for v in values)), ",").try_cast("array<bigint>")


def partition_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of n shuffle partitions an int that Spark's hash partitioning puts there,
    so that n ranges go to n different tasks."""
    ids = spark.range(n * 24).select(F.col("id").alias("k"))
    rows = ids.groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).agg(F.min("k").alias("k")).collect()
    found = {r.p: r.k for r in rows}
    spare = iter(range(n * 24, n * 48))
    return [found[p] if p in found else next(spare) for p in range(n)]


def range_bounds(df: DataFrame, col: str, n: int) -> list[int]:
    """At most n-1 ascending cut points of an integer column, from a scan of that column alone."""
    if n <= 1:
        return []
    cuts = df.select(col).stat.approxQuantile(col, [i / n for i in range(1, n)], 1 / (4 * n))
    return sorted({int(c) for c in cuts})


def range_of(col: Column, bounds: list[int]) -> Column:
    """Index of the range of a value: the number of cut points at or below it. Null: 0."""
    if not bounds:
        return F.lit(0)
    size = 1 << (len(bounds)).bit_length()
    cuts = listed(bounds)
    # binary search: the cut points below, by halving steps
    steps = F.array(*[F.lit(size >> k) for k in range(1, size.bit_length())])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.try_element_at(cuts, at + step) <= col), at + step).otherwise(at))
    return F.coalesce(found, F.lit(0))
