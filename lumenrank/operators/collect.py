"""Citations gathered from raw answers, winners over ours, ranks looked up, skips by question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from .ranking import first_per, top_per


def collect_citations(raw: DataFrame, most: int = 30) -> DataFrame:
    """(answer_id, kind, ordinal, url, domain): the cited, then the consulted that are not cited;
    each (domain, url) once, in order, at most ``most`` of a kind."""
    rows = raw.withColumn("domain", U.registrable(F.col("url"))).where("domain is not null")
    one = first_per(rows, ["answer_id", "kind", "domain", "url"], [F.col("ordinal")])
    cited = one.where("kind = 'cited'")
    consulted = one.where("kind = 'consulted'").join(cited.select("answer_id", "domain", "url"), ["answer_id", "domain", "url"], "left_anti")
    kept = cited.select("answer_id", "kind", "domain", "url", "ordinal").unionByName(consulted.select("answer_id", "kind", "domain", "url", "ordinal"))
    return top_per(kept, ["answer_id", "kind"], [F.col("ordinal")], most, "place").select("answer_id", "kind", "place", "url", "domain")


def redirect_domain(url: Column, title: Column, redirect_host: str) -> Column:
    """A redirect's domain comes from its title, if that is a host name."""
    name = U.normalize_domain(title)
    return F.when(U.host(url) == redirect_host, F.when(U.is_hostname(name), name)).otherwise(U.registrable(url))


def first_positive(*counts: Column) -> Column:
    return F.coalesce(*[F.when(c > 0, c) for c in counts])


def winners(citations: DataFrame, missing: DataFrame, per_engine: int = 3, most: int = 10) -> DataFrame:
    """(page, answers, engines, place): pages of others cited where we are missing: the first of
    each engine, then the first of all."""
    lost = citations.where(~F.col("own")).join(missing.select("answer_id"), "answer_id", "left_semi")
    counted = lost.select("engine", "answer_id", "page").distinct().groupBy("engine", "page").agg(F.count(F.lit(1)).alias("n"))
    best = top_per(counted, ["engine"], [F.desc("n"), F.col("page")], per_engine)
    all_ = best.groupBy("page").agg(F.sum("n").alias("answers"), F.count(F.lit(1)).alias("engines")).orderBy(F.desc("answers"), "page").limit(most)
    return all_.withColumn("place", F.row_number().over(Window.orderBy(F.desc("answers"), "page")))


def rank_lookup(pages: DataFrame, results: DataFrame, phrases: int) -> DataFrame:
    """(url, phrase, rank): the least position of a page for its phrase, for the first phrases by importance, then by place, then by name."""
    first = pages.groupBy("phrase").agg(F.min(F.struct(-F.col("importance"), F.col("ordinal"))).alias("o")).orderBy("o", "phrase").limit(phrases).select("phrase")
    asked = pages.join(first, "phrase", "left_semi").select("url", "phrase", U.page_identity(F.col("url")).alias("page"))
    met = results.select("phrase", U.page_identity(F.col("url")).alias("page"), "position")
    return asked.join(met, ["phrase", "page"], "left").groupBy("url", "phrase").agg(F.min("position").alias("rank"))


def group_skips(skips: DataFrame) -> DataFrame:
    """(question_id, engines, reasons, score): one skip an engine, the first; reasons by how often,
    the least score; unknown scores before all."""
    one = first_per(skips, ["question_id", "engine"], [F.col("ordinal")])
    each = one.select("question_id", F.explode("reasons").alias("reason")).groupBy("question_id", "reason").agg(F.count(F.lit(1)).alias("n"))
    listed = each.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "reason"))).alias("r"))
    scores = one.groupBy("question_id").agg(F.count(F.lit(1)).alias("engines"), F.min(F.coalesce("score", F.lit(-1.0))).alias("score"))
    return scores.join(listed, "question_id").select("question_id", "engines", F.array_join(F.transform("r", lambda x: x["reason"]), ",").alias("reasons"), "score")
