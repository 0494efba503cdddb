"""First of a group, top-k, quotas, round robin and ordered unions, by ordinals that settle ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group; Spark prunes the others before the shuffle."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= k)
    return ranked.withColumnRenamed("__n", rank) if rank else ranked.drop("__n")


def round_robin(df: DataFrame, group: str, group_order: Column, order: list[Column], k: int) -> DataFrame:
    """k rows taking the best of each group in turn, groups in their own order; ``place`` from 1.

    Only the first k of a group can be taken, so each group is cut to k before the last sort.
    """
    dealt = top_per(df, [group], order, k, "__round").withColumn("__group", group_order)
    best = dealt.orderBy("__round", "__group").limit(k)
    return best.withColumn("place", F.row_number().over(Window.orderBy("__round", "__group"))).drop("__round", "__group")


def ordered_union(parts: list[DataFrame]) -> DataFrame:
    """Rows of the parts one after the other: ``ord`` is (part, ordinal in the part)."""
    named = [p.withColumn("ord", F.struct(F.lit(i).alias("part"), F.col("ordinal").cast("long").alias("at"))).drop("ordinal") for i, p in enumerate(parts)]
    out = named[0]
    for p in named[1:]:
        out = out.unionByName(p)
    return out


def merge_by_key(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """One row a key: the first spelling, all sources in order, the place of the first."""
    return df.groupBy(key).agg(F.min_by(text, "ord").alias(text), F.sort_array(F.collect_set(source)).alias("sources"), F.min("ord").alias("ord"))


def pick_with_quota(df: DataFrame, order: list[Column], limited: Column, share: float, k: int) -> DataFrame:
    """The best k, of which at most ceil(share * k) are limited. A row over the quota is passed
    by for good, so dropping the limited ones beyond the quota first gives the same."""
    quota = -int(-(share * k) // 1)
    marked = df.withColumn("__limited", limited)
    parts = marked.withColumn("__n", F.row_number().over(Window.partitionBy("__limited").orderBy(*order)))
    kept = parts.where((~F.col("__limited") & (F.col("__n") <= k)) | (F.col("__limited") & (F.col("__n") <= quota)))
    best = kept.orderBy(*order).limit(k)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*order))).drop("__limited", "__n")
