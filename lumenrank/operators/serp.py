"""Result lists: targets, dominance, strength, weakness, intent votes, visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import weights as W
from ..functions.numbers import clamp01, r3, ratio3
from .ranking import first_per, top_per


def by_position(values: list[int], rest: int, position: Column) -> Column:
    """A table by position from 1; ``rest`` beyond its end or without a position."""
    table = F.array(*[F.lit(v).cast("long") for v in values])
    return F.coalesce(F.get(table, F.when(position >= 1, position.cast("int") - 1)), F.lit(rest).cast("long"))


def select_targets(results: DataFrame, own: str, deep: int, cap: int, manual: DataFrame | None = None) -> DataFrame:
    """Per keyword the first result of each domain until ``deep``, every own hit and the manual
    addresses; at most ``cap``, own and manual before the rest, in order of position."""
    firsts = top_per(first_per(results, ["keyword", "domain"], [F.col("position")]), ["keyword"], [F.col("position")], deep)
    kept = firsts.unionByName(results.where(F.col("domain") == own)).withColumn("manual", F.lit(False))
    if manual is not None:
        kept = kept.unionByName(manual.withColumn("manual", F.lit(True)), allowMissingColumns=True)
    one = first_per(kept, ["keyword", "url"], [F.desc("manual"), F.col("position").asc_nulls_last()])
    must = F.when(F.col("manual") | (F.col("domain") == own), 0).otherwise(1)
    place = F.coalesce(F.col("position"), F.lit(999))
    chosen = top_per(one.withColumn("must", must), ["keyword"], [F.col("must"), place, F.col("url")], cap)
    order = Window.partitionBy("keyword").orderBy(F.coalesce(F.col("position"), F.lit(999)), "url")
    return chosen.withColumn("rank", F.row_number().over(order)).drop("must")


def topical_dominance(results: DataFrame, top: int = 5, least_lists: int = 3) -> DataFrame:
    """(domain, lists, dominance): share of the lists with the domain among the first ``top``."""
    lists = results.agg(F.count_distinct("keyword").alias("n_lists"))  # one row
    seen = results.where(F.col("position") <= top).select("keyword", "domain").distinct()
    counted = seen.groupBy("domain").agg(F.count(F.lit(1)).alias("lists"))
    return counted.crossJoin(F.broadcast(lists)).where(F.col("n_lists") >= least_lists).select("domain", "lists", ratio3(F.col("lists"), F.col("n_lists")).alias("dominance"))


def type_fit(page_type: Column, intent: Column) -> Column:
    """How well a type of page serves an intent; null for an unknown type."""
    table = lambda v: F.create_map(*[F.lit(x) for pair in zip(W.PAGE_TYPES, v, strict=True) for x in pair])
    return F.try_element_at(F.when(intent == "informational", table(W.FIT_INFORMATIONAL)).otherwise(table(W.FIT_COMMERCIAL)), page_type)


def result_strength(fit: Column, dedicated: Column, title: Column, dominance: Column, depth: Column) -> Column:
    """Weighted mean; unknown fit or dedication counts a half, unknown depth not at all."""
    s = W.STRENGTH
    known = F.coalesce(fit, F.lit(0.5)) * s["type_fit"] + F.coalesce(dedicated, F.lit(0.5)) * s["dedicated"] + clamp01(title) * s["title_match"] + F.coalesce(dominance, F.lit(0.0)) * s["dominance"]
    rest = s["type_fit"] + s["dedicated"] + s["title_match"] + s["dominance"]
    return F.when(depth.isNull(), known / F.lit(rest)).otherwise((known + clamp01(depth) * s["depth"]) / F.lit(rest + s["depth"]))


def assess(observations: DataFrame) -> DataFrame:
    """One row a keyword from (keyword, position, page_type, fit, dedicated, title, dominance,
    depth, strength): position-weighted means, shares of types, and how hard the list is."""
    w = by_position(W.POSITION_WEIGHTS, W.POSITION_REST, F.col("position")).cast("double")
    mean = lambda x: F.sum(w * x) / F.nullif(F.sum(F.when(x.isNotNull(), w)), F.lit(0.0))
    out = observations.groupBy("keyword").agg(
        mean(1 - F.col("strength")).alias("weakness_raw"),
        r3(mean(1 - F.coalesce("fit", F.lit(0.5)))).alias("type_mismatch"),
        r3(mean(1 - F.coalesce("dedicated", F.lit(0.5)))).alias("not_dedicated"),
        r3(mean(1 - F.col("title"))).alias("title_gap"),
        r3(mean(F.coalesce("dominance", F.lit(0.0)))).alias("dominance"),
        r3(mean(1 - F.col("depth"))).alias("thin_content"),
    )
    level = F.when(F.col("weakness_raw") >= W.EASY_AT, "easy").when(F.col("weakness_raw") >= W.MEDIUM_AT, "medium").otherwise("hard")
    return out.withColumn("difficulty", level).withColumn("weakness", r3(F.col("weakness_raw"))).drop("weakness_raw")


def vote_shares(votes: DataFrame, keys: list[str], choice: str, weight: str, ordinal: str) -> DataFrame:
    """(keys, choice, share, dominant) from whole-number weights: each choice's share of its
    group, and the group's greatest, the first to appear of equals."""
    summed = votes.groupBy(*keys, choice).agg(F.sum(weight).alias("__w"), F.min(ordinal).alias("__o"))
    group = Window.partitionBy(*keys)
    total = F.sum("__w").over(group)
    first = F.max_by(F.col(choice), F.struct(F.col("__w"), -F.col("__o"))).over(group)
    return summed.select(*keys, choice, ratio3(F.col("__w"), total).alias("share"), first.alias("dominant"))


def competitor_profiles(results: DataFrame, own: str, tracked: list[str], limit: int = 12) -> DataFrame:
    """Visibility of each domain seen, tracked or owned: distinct keywords, how often in the first
    3 and 10 (once a keyword, by its first row), best and mean position, share of voice; own
    first, then tracked, then discovered, by share."""
    spark = results.sparkSession
    ctr = by_position(W.CTR_CURVE, W.CTR_REST, F.col("position"))
    first = F.row_number().over(Window.partitionBy("domain", "keyword").orderBy("position"))
    rows = results.select("domain", "keyword", "position", ctr.alias("ctr"), (first == 1).alias("first"))
    seen = rows.groupBy("domain").agg(
        F.count_if("first").alias("keywords"),
        F.count_if(F.col("first") & (F.col("position") <= 3)).alias("top3"),
        F.count_if(F.col("first") & (F.col("position") <= 10)).alias("top10"),
        F.min("position").alias("best"),
        F.sum("position").alias("positions"),
        F.count(F.lit(1)).alias("rows"),
        F.sum("ctr").alias("ctr"),
    )
    total = seen.agg(F.sum("ctr").alias("all_ctr"))  # one row
    named = spark.createDataFrame([(d,) for d in dict.fromkeys([own, *tracked])], "domain string")
    both = seen.join(F.broadcast(named), "domain", "full").crossJoin(F.broadcast(total))
    role = F.when(F.col("domain") == own, "own").when(F.col("domain").isin(tracked), "tracked").otherwise("discovered")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    out = both.select(
        "domain", role.alias("role"), zero("keywords"), zero("top3"), zero("top10"), "best",
        ratio3(F.col("positions"), F.col("rows")).alias("avg_position"),
        F.coalesce(ratio3(F.col("ctr"), F.col("all_ctr")), F.lit(0.0)).alias("share_of_voice"), F.coalesce("ctr", F.lit(0).cast("long")).alias("__ctr"),
    )
    rank = F.when(F.col("role") == "own", 0).when(F.col("role") == "tracked", 1).otherwise(2)
    best = out.withColumn("__rank", rank).orderBy("__rank", F.desc("__ctr"), "domain").limit(limit)
    return best.withColumn("place", F.row_number().over(Window.orderBy("__rank", F.desc("__ctr"), "domain"))).drop("__rank", "__ctr")


def vulnerable_keywords(rows: DataFrame, k: int = 5) -> DataFrame:
    """(domain, keyword, position, strength, reason, place): from third place on and weak, the
    worst positions of each domain first."""
    weak = rows.where((F.col("position") >= 3) & (F.col("strength") < 0.5))
    reason = F.when(F.col("fit") < 0.5, "wrong_type").when(F.col("dedicated") < 0.5, "not_dedicated").when(F.col("title") < 0.5, "title_gap").otherwise("shallow")
    return top_per(weak.withColumn("reason", reason), ["domain"], [F.desc("position"), F.col("keyword")], k, "place").select("domain", "keyword", "position", r3(F.col("strength")).alias("strength"), "reason", "place")


def competitor_overview(profiles: DataFrame, tracked: list[str]) -> DataFrame:
    """Across reports (report, domain, keywords, share in thousandths, best, created_at)."""
    spark = profiles.sparkSession
    named = spark.createDataFrame([(d, True) for d in tracked], "domain string, tracked boolean")
    seen = profiles.groupBy("domain").agg(
        F.count_distinct("report").alias("reports"), F.sum("keywords").alias("keywords"), ratio3(F.sum("share"), F.count(F.lit(1)) * 1000).alias("avg_share"),
        F.min("best").alias("best"), F.max("created_at").alias("last_seen"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return seen.join(F.broadcast(named), "domain", "full").select("domain", F.coalesce("tracked", F.lit(False)).alias("tracked"), zero("reports"), zero("keywords"), "avg_share", "best", "last_seen")


def untracked_suggestions(overview: DataFrame, k: int = 25) -> DataFrame:
    order = [F.desc("reports"), F.desc_nulls_last("avg_share"), F.col("domain")]
    return overview.where(~F.col("tracked")).orderBy(*order).limit(k)
