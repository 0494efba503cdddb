"""Mixing sources to target weights.

Sizes are aggregated by source, the targets are filled up to their caps, each source gets the
repetition rate target / size, and a document is taken floor(rate) times plus one more time if
its hash falls below the fraction. The draw depends on the id and the seed alone, so reruns and
retried tasks agree. The rates meet the documents in a join on the source that Catalyst
broadcasts only if the written table is below its threshold, and that it can split where one
source holds much of the rows.

Rows: null text has size 0 and is taken 0 words; a null source is a source of its own, the last
in order; rows repeating an id share its draw; with no words at all every target is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import free_name, listed, materialize, width

WORD = r"[^\x20\x09-\x0D]+"
DRAW_DIGITS = 13  # hex digits of the hash that make the draw: 52 bits, exact in a double


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def numbered(rows: DataFrame, order: Column) -> DataFrame:
    """``rows`` with ``at``, their place from 0: ranges of the order are sorted apart, and each begins
    where the ranges before it end, so however many sources there are no task sorts them all."""
    spark = rows.sparkSession
    dealt = materialize(rows.repartitionByRange(width(spark), order).withColumn("part", F.spark_partition_id()), "mix-order")
    counts = {r.part: r.n for r in dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a range
    before, starts = 0, []
    for part in range(max(counts, default=0) + 1):
        starts.append(before)
        before += counts.get(part, 0)
    inside = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return dealt.withColumn("at", F.element_at(listed(starts), F.col("part") + 1) + inside - 1).drop("part")


def source_targets(sizes: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Water level: a source gets weight * level, but at most cap * its size; the level is raised
    over the sources that are not full until none is above. Each step is one aggregate.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = numbered(by_source, F.col("source").asc_nulls_last())
    weighed = materialize(
        named.select(
            "source",
            "source_size",
            F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int")).alias("weight"),
            (F.col("source_size") * F.lit(float(cap))).alias("most"),
        ),
        "mix-sources",
    )
    total = share * (weighed.agg(F.sum("source_size").alias("s")).first().s or 0)
    level, full = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > F.col("most")
        got = weighed.agg(
            F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0.0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("open"),
            F.count_if(over).alias("full"),
        ).first()
        if got.full == full or not got.open:
            break
        full, level = got.full, (total - got.fixed) / got.open
    return weighed.select("source", "source_size", F.least(F.col("weight") * F.lit(level), F.col("most")).alias("target"))


def copies_of(id_col: Column, rate: Column, seed: str) -> Column:
    """floor(rate) plus a Bernoulli draw with the fraction as probability, seeded by a hash."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), id_col.cast("string"))), 1, DRAW_DIGITS), 16, 10).cast("double") / F.lit(float(16**DRAW_DIGITS))
    return (F.floor(rate) + F.when(drawn < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def plan_mix(docs: DataFrame, weights: list[float], share: float = 1.5, cap: float = 2.0, seed: str = "mix", id_col: str = "doc_id") -> DataFrame:
    """(id, size, source_size, target, rate, copies): how often each document is taken."""
    sizes = materialize(docs.select(F.col(id_col).alias("id"), F.col("source"), size_of(F.col("text")).alias("size")), "mix-sizes")
    targets = materialize(source_targets(sizes, weights, share, cap), "mix-targets")
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size").cast("double"), F.lit(0.0)), F.lit(0.0))
    joined = sizes.join(targets.withColumnRenamed("source", "target_source"), F.col("source").eqNullSafe(F.col("target_source")))
    return joined.select("id", "source", "size", "source_size", "target", rate.alias("rate")).withColumn("copies", copies_of(F.col("id"), F.col("rate"), seed))


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, cap: float = 2.0, seed: str = "mix", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, in one pass over the texts."""
    counts = docs.select(F.col("source"), size_of(F.col("text")).alias("size"))
    name, rate, copy = (free_name(docs, x) for x in ("mix_source", "mix_rate", "mix_copy"))
    targets = materialize(source_targets(counts, weights, share, cap), "mix-targets").select(
        F.col("source").alias(name), F.coalesce(F.col("target") / F.nullif(F.col("source_size").cast("double"), F.lit(0.0)), F.lit(0.0)).alias(rate)
    )
    joined = docs.join(targets, F.col("source").eqNullSafe(F.col(name)))
    taken = F.array_repeat(F.lit(1), copies_of(F.col(id_col), F.col(rate), seed))
    return joined.withColumn(copy, F.explode(taken)).select(*docs.columns)
