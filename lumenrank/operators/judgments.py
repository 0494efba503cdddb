"""Typed probabilistic judgments: distributions put right, read as yes or no, choice or score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import r3


def normalised(probs: Column, options: list[str]) -> Column:
    """A share for every option: finite, not negative, summing to one; all alike if there is nothing."""
    raw = F.array(*[F.coalesce(F.try_element_at(probs, F.lit(o)), F.lit(0.0)) for o in options])
    clean = F.transform(raw, lambda x: F.when(F.isnan(x) | (x < 0) | (x == float("inf")), 0.0).otherwise(x))
    total = F.aggregate(clean, F.lit(0.0), lambda a, x: a + x)
    shares = F.transform(clean, lambda x: F.when(total > 0, x / F.when(total > 0, total)).otherwise(1.0 / len(options)))
    return F.map_from_arrays(F.array(*[F.lit(o) for o in options]), shares)


def choice(probs: Column, options: list[str]) -> Column:
    """struct(value, p, runner_up, confidence); of equals the first option."""
    ranked = F.sort_array(F.array(*[F.struct((-F.coalesce(F.try_element_at(probs, F.lit(o)), F.lit(0.0))).alias("less"), F.lit(i).alias("ord"), F.lit(o).alias("name")) for i, o in enumerate(options)]))
    top, n = -F.get(ranked, F.lit(0))["less"], len(options)
    sure = (top - 1.0 / n) / (1 - 1.0 / n) if n > 1 else F.lit(1.0)
    return F.struct(F.get(ranked, F.lit(0))["name"].alias("value"), r3(top).alias("p"), F.get(ranked, F.lit(1))["name"].alias("runner_up"), r3(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure))).alias("confidence"))


def score_of(levels: Column) -> Column:
    """Mean level as a share of the highest, from the levels' probabilities in order."""
    total = F.aggregate(F.transform(levels, lambda p, i: p * i), F.lit(0.0), lambda a, x: a + x)
    return r3(total / (F.size(levels) - 1))


def score_confidence(levels: Column) -> Column:
    """1 less the mean distance to the mode over the distance of an even guess to the middle."""
    mode = F.array_position(levels, F.array_max(levels)) - 1
    near = F.aggregate(F.transform(levels, lambda p, i: p * F.abs(i - mode)), F.lit(0.0), lambda a, x: a + x)
    even = F.aggregate(F.transform(levels, lambda p, i: F.abs(i - (F.size(levels) - 1) / 2.0)), F.lit(0.0), lambda a, x: a + x) / F.size(levels)
    return r3(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - near / F.nullif(even, F.lit(0.0)))))


def yes_confidence(p: Column) -> Column:
    return F.abs(p * 2 - 1)


def merge(one: Column, two: Column) -> Column:
    """Mean of a distribution and its twin asked the other way round."""
    return F.map_zip_with(one, two, lambda _, a, b: (F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))) / 2)


def wide(judged: DataFrame, questions: list[str]) -> DataFrame:
    """One row an entity from (entity_id, question_id, p): a column a question, and how complete."""
    out = judged.groupBy("entity_id").pivot("question_id", questions).agg(F.first("p"))
    known = sum((F.col(q).isNotNull().cast("int") for q in questions), F.lit(0))
    return out.withColumn("status", F.when(known == 0, "none").when(known < len(questions), "partial").otherwise("complete"))


def request_key(state: Column, questions: Column) -> Column:
    """What a judgment is stored under: equal requests are asked once."""
    return F.sha1(F.concat_ws("\n", F.to_json(state), questions))


def judged(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Requests with their stored answers; null where none is."""
    return requests.join(stored.select("request", "answer"), "request", "left")
