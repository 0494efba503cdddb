"""Interactive lists: filters, facets counted under the other filters, sorting with placed nulls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def facets(df: DataFrame, chosen: dict[str, list[str]]) -> DataFrame:
    """(facet, value, n): each facet's values counted under what is chosen in the others.

    One pass: rows are counted by all facets at once, and the small table by each.
    """
    counts = df.groupBy(*chosen).agg(F.count(F.lit(1)).alias("c"))
    parts = []
    for facet in chosen:
        rules = [F.col(k).isin(v) for k, v in chosen.items() if k != facet and v]
        rest = counts.where(reduce(lambda a, b: a & b, rules)) if rules else counts
        parts.append(rest.groupBy(F.col(facet).alias("value")).agg(F.sum("c").alias("n")).select(F.lit(facet).alias("facet"), "value", "n"))
    return reduce(DataFrame.unionByName, parts)


def numbered(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first rows of an order with their places."""
    return df.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))
