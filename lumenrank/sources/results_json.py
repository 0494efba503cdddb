"""Raw answers of search interfaces, as JSON strings, to result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U

RESULT = "array<struct<position: int, link: string, title: string, snippet: string>>"
FLAT = f"organic {RESULT}, peopleAlsoAsk array<struct<question: string>>, relatedSearches array<struct<query: string>>"
TASKS = "status_code int, tasks array<struct<status_code: int, result: array<struct<items: array<struct<type: string, rank_group: int, url: string, title: string, description: string, items: array<string>>>>>>>"


def _rows(df: DataFrame, items: Column) -> DataFrame:
    """(keyword, position, url, domain, title, snippet) from an array of results: http(s) only,
    an address once, positions given or counted."""
    each = df.select("keyword", F.posexplode(items).alias("at", "r"))
    made = each.select(
        "keyword", "at", F.coalesce(F.when(F.col("r.position") > 0, F.col("r.position")), F.col("at") + 1).alias("position"), F.trim("r.link").alias("url"),
        T.squash(F.col("r.title")).alias("title"), T.squash(F.col("r.snippet")).alias("snippet"),
    ).where(F.col("url").rlike("^(?i:https?)://"))
    one = made.groupBy("keyword", "url").agg(F.min_by(F.struct("position", "title", "snippet", "at"), "at").alias("r"))
    return one.select("keyword", "r.position", "url", U.registrable(F.col("url")).alias("domain"), "r.title", "r.snippet")


def flat_results(raw: DataFrame) -> DataFrame:
    """From (keyword, json) of the interface with one object an answer."""
    return _rows(raw, F.from_json("json", FLAT)["organic"])


def flat_questions(raw: DataFrame) -> DataFrame:
    """(keyword, kind, ordinal, text): questions and related searches, each text once, first place."""
    parsed = raw.select("keyword", F.from_json("json", FLAT).alias("j"))
    paa = parsed.select("keyword", F.lit("paa").alias("kind"), F.posexplode("j.peopleAlsoAsk.question").alias("ordinal", "text"))
    related = parsed.select("keyword", F.lit("related").alias("kind"), F.posexplode("j.relatedSearches.query").alias("ordinal", "text"))
    both = paa.unionByName(related).withColumn("text", T.squash(F.col("text"))).where("text <> ''")
    return both.groupBy("keyword", "kind", F.lower("text").alias("low")).agg(F.min_by("text", "ordinal").alias("text"), F.min("ordinal").alias("ordinal")).drop("low")


def task_results(raw: DataFrame) -> DataFrame:
    """From (keyword, json) of the interface with tasks; those that failed give no rows."""
    parsed = raw.select("keyword", F.explode(F.from_json("json", TASKS)["tasks"]).alias("t")).where("t.status_code = 20000")
    items = F.filter(F.flatten(F.transform("t.result", lambda r: r["items"])), lambda i: i["type"] == "organic")
    return _rows(parsed, F.transform(items, lambda i: F.struct(i["rank_group"].alias("position"), i["url"].alias("link"), i["title"].alias("title"), i["description"].alias("snippet"))))


def error_kind(status: Column) -> Column:
    return F.when(status.isin(40100, 40101, 401, 403), "auth").when(status.isin(40200, 40201, 402, 429), "quota").when(status >= 50000, "server").when(status != 20000, "request")


def manual_results(keyword: str, addresses: DataFrame) -> DataFrame:
    """(ordinal, url) given by the user as a list of results."""
    return addresses.select(F.lit(keyword).alias("keyword"), (F.col("ordinal") + 1).alias("position"), "url", U.registrable(F.col("url")).alias("domain"))


def wanted_volumes(keywords: DataFrame, most: int = 1000) -> DataFrame:
    """Keywords to ask volumes for: trimmed, once each, at most 80 characters and 10 words."""
    made = keywords.select(F.lower(T.squash(F.col("keyword"))).alias("keyword"), "ordinal").where("length(keyword) between 1 and 80").where(F.size(F.split("keyword", " ")) <= 10)
    return made.groupBy("keyword").agg(F.min("ordinal").alias("ordinal")).orderBy("ordinal").limit(most)
