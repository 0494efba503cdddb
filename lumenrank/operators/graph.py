"""Reachability over edge tables: least node reached along edges, and components.

Each round is a few joins and minima of narrow rows, written and read back, so that a plan holds one round and a
lost executor costs one; the round before it is deleted. A node takes the least label of those it has an edge to, and then the
label of its label, which halves what is left of long chains. No group is ever gathered: a hot node is a hot key of a join
and of a minimum that is taken in part before the shuffle.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard, written


def least_reached(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges(u, v)``: the least node that can be reached from it along edges u to v, itself included."""
    arcs = written(edges.select("u", "v").where("u <> v").distinct(), "graph-arcs")
    nodes = arcs.select(F.col("u").alias("node")).unionByName(arcs.select(F.col("v").alias("node"))).distinct()
    now = written(nodes.select("node", F.col("node").alias("label")), "graph-labels")
    while True:
        ahead = arcs.join(now.select(F.col("node").alias("v"), F.col("label").alias("seen")), "v").groupBy(F.col("u").alias("node")).agg(F.min("seen").alias("seen"))
        step = written(now.join(ahead, "node", "left").select("node", F.least("label", F.coalesce("seen", "label")).alias("label"), F.col("label").alias("was")), "graph-step")
        jumped = step.join(step.select(F.col("node").alias("label"), F.col("label").alias("beyond")), "label")
        after = written(jumped.select("node", F.least("label", "beyond").alias("label"), (F.least("label", "beyond") < F.col("was")).alias("moved")), "graph-labels")
        discard(now)
        discard(step)
        now = after
        if now.where("moved").isEmpty():
            discard(arcs)
            return now.select("node", "label")


#: Edges that the driver takes at once; rounds take seconds, however few there are.
FEW = 1 << 18


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges(u, v)``: the least node of its component."""
    arcs = written(edges.select("u", "v").where("u <> v").distinct(), "graph-edges")
    if arcs.count() > FEW:
        out = least_reached(arcs.unionByName(arcs.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        discard(arcs)
        return out
    got = arcs.toArrow()
    discard(arcs)
    above: dict = {}

    def top(x):
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    for u, v in zip(*(c.to_pylist() for c in got.columns), strict=True):
        u, v = top(u), top(v)
        above[max(u, v)] = min(u, v)
    kind = got.schema.field("u").type
    found = pa.table({"node": pa.array(list(above), kind), "label": pa.array([top(x) for x in list(above)], kind)})
    return written(edges.sparkSession.createDataFrame(found), "graph-labels")
