"""Keyword candidates: score, label, reasons and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import weights as W
from ..functions.numbers import clamp01, r1


def specificity(terms: Column, local: Column) -> Column:
    """From the number of terms, a little more with a place name."""
    base = F.when(terms <= 1, 0.2).when(terms == 2, 0.45).when(terms == 3, 0.7).when(terms == 4, 0.9).otherwise(1.0)
    return clamp01(base + F.when(local, 0.1).otherwise(0.0))


def demand(volume: Column) -> Column:
    return clamp01(F.log10(volume + 1) / 3.5)


def score(relevance: Column, weakness: Column, commercial: Column, specific: Column, wanted: Column) -> Column:
    """0 to 100 to one decimal; a keyword whose result list was not seen stays under a cap."""
    o = W.OPPORTUNITY
    mean = F.coalesce(weakness, F.lit(W.NEUTRAL_WEAKNESS)) * o["weakness"] + commercial * o["commercial"] + specific * o["specificity"] + F.coalesce(wanted, F.lit(W.NEUTRAL_DEMAND)) * o["demand"]
    raw = relevance * mean * 100
    return r1(F.when(weakness.isNull(), F.least(raw, F.lit(W.UNVERIFIED_CAP))).otherwise(raw))


def label(relevance: Column, points: Column, difficulty: Column) -> Column:
    return (
        F.when(relevance < W.MIN_RELEVANCE, "skip")
        .when((difficulty == "easy") & (points >= W.QUICK_WIN_AT), "quick_win")
        .when(points >= W.GOOD_AT, "good")
        .when(points >= W.HARD_AT, "hard")
        .otherwise("skip")
    )


def label_ordinal(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in W.LABELS]), name)


def reasons(weakness: Column, mismatch: Column, not_dedicated: Column, title_gap: Column, thin: Column, dominance: Column, commercial: Column, volume: Column, specific: Column) -> Column:
    """At most six, in order."""
    rules = [
        (mismatch >= 0.45, "weak_types"), (not_dedicated >= 0.4, "not_dedicated"), (title_gap >= 0.35, "title_gap"), (thin >= 0.5, "thin"), (dominance >= 0.5, "dominated"),
        (weakness < 0.4, "strong_pages"), (commercial >= 0.65, "commercial"), (commercial <= 0.3, "informational"), (volume.isNotNull(), "volume"), (specific >= 0.9, "specific"),
    ]
    return F.slice(F.array_compact(F.array(*[F.when(rule, F.lit(name)) for rule, name in rules])), 1, 6)


def best_format(dominant_type: Column, intent: Column) -> Column:
    by_intent = F.when(intent == "informational", "blog_article").when(intent == "comparison", "comparison_listicle").when(intent == "navigational", "company_homepage").otherwise("service_page")
    return F.coalesce(dominant_type, by_intent)


def rank(scored: DataFrame) -> DataFrame:
    return scored.orderBy(label_ordinal(F.col("label")), F.desc("score"), "keyword")
