"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, materialize


def _met(rows: DataFrame, on: str, low: DataFrame) -> DataFrame:
    """``rows`` with the minima of their nodes, a written table: so both sides of the join are plain,
    and Spark can hand out the smaller or split the tasks of a node that has many rows."""
    return rows.join(low, on)


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-low")
    return _met(both, "u", low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), low


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
    rest = _met(down, "u", low).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), low


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(u, v)``: root is the smallest node of its component.

    Ends when each node points at a root that points nowhere: then the edges are stars. Every
    round is written to the shared folder, so a lost executor costs one round at most; the round
    before it is deleted then.
    """
    now = materialize(edges.select("u", "v").where("u <> v").distinct(), "cc-edges")
    while True:
        star, low = _large_star(now)
        larger = materialize(star, "cc-large")
        star, lower = _small_star(larger)
        after = materialize(star, "cc-round")
        for done in (now, low, larger, lower):
            discard(done)
        now = after
        deep = now.join(now.select(F.col("u").alias("v")), "v", "left_semi")
        many = now.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if deep.isEmpty() and many.isEmpty():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
