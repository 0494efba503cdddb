"""Lists and figures of the report's panels: orders, filters, totals, notes, warnings, estimates."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import weights as W
from .ranking import top_per


def in_order(values: list[str], c: Column) -> Column:
    """Place of a value in a fixed order."""
    return F.array_position(F.array(*[F.lit(v) for v in values]), c)


def citability_rows(pages: DataFrame, most: int = 100) -> DataFrame:
    """The first ``most``, the worst first, what could not be judged last; with the place."""
    order = [F.asc_nulls_last("now"), F.col("url")]
    return pages.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def answer_counts(answers: DataFrame) -> DataFrame:
    """By engine: all, won (cited or named) and lost; a failed call says nothing of us."""
    return answers.groupBy("engine").agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("status").isin("cited", "named")).alias("won"), F.count_if(F.col("status") == "missing").alias("lost"))


def question_index(questions: DataFrame, skips: DataFrame) -> DataFrame:
    """(question_id, text): from the list of questions, else from a skip that has it."""
    own = questions.where(F.trim("text") != "").groupBy("question_id").agg(F.min("text").alias("a"))
    more = skips.where(F.trim("text") != "").groupBy("question_id").agg(F.min("text").alias("b"))
    return own.join(more, "question_id", "full").select("question_id", F.coalesce("a", "b").alias("text"))


def sorted_plans(plans: DataFrame, engines: list[str]) -> DataFrame:
    """Plans by priority and kind, each with its engines in their fixed order."""
    listed = F.filter(F.array(*[F.lit(e) for e in engines]), lambda e: F.array_contains("engines", e))
    return plans.withColumn("engines", listed).withColumn("place", F.row_number().over(Window.orderBy(F.desc("priority"), F.col("kind"), F.col("key"))))


def sorted_winners(winners: DataFrame, most: int = 10) -> DataFrame:
    """The most cited first, of equals the better built, then by name."""
    order = [F.desc("cited_in"), F.desc("score10"), F.col("domain")]
    return winners.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def visible_domains(cited: DataFrame, first: int) -> DataFrame:
    """Of each engine the first domains, and our own wherever it stands."""
    placed = cited.withColumn("place", F.row_number().over(Window.partitionBy("engine").orderBy(F.desc("n"), F.col("domain"))))
    return placed.where((F.col("place") <= first) | F.col("own"))


def type_shares(results: DataFrame, most: int = 6) -> DataFrame:
    """The page types of a keyword's results by their share, the greatest first."""
    counted = results.groupBy("keyword", "page_type").agg(F.count(F.lit(1)).alias("n"))
    share = counted.withColumn("all", F.sum("n").over(Window.partitionBy("keyword")))
    return top_per(share, ["keyword"], [F.desc("n"), F.col("page_type")], most, "place").select("keyword", "page_type", "n", (F.floor((F.col("n") * 2000 + F.col("all")) / (F.col("all") * 2)) / 1000.0).alias("share"), "place")


def search_reports(reports: DataFrame, text: str) -> DataFrame:
    """Reports whose keyword or first domain has the text, in any case."""
    has = lambda c: F.contains(F.lower(c), F.lit(text.lower()))
    return reports.where(has("keyword") | F.coalesce(has("top_domain"), F.lit(False)))


def running_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin("queued", "running")).groupBy("kind", "status").agg(F.count(F.lit(1)).alias("jobs"))


def usage_rows(calls: DataFrame) -> DataFrame:
    """Calls, tokens and cost by service; unknown if the price of any call is."""
    return calls.groupBy("service").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"), F.when(F.count("cost_micro") == F.count(F.lit(1)), F.sum("cost_micro")).alias("cost_micro"), F.count_if("failed").alias("failed")
    )


def run_status(pages: DataFrame) -> DataFrame:
    """Whether a site's audit is whole, and what to warn of: pages blocked, failed, judged in part."""
    out = pages.groupBy("site").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("fetch") == "blocked_robots").alias("blocked"), F.count_if(~F.col("fetch").isin("ok", "blocked_robots")).alias("unread"),
        F.count_if((F.col("fetch") == "ok") & (F.col("judged") != "complete")).alias("in_part"),
    )
    said = [("blocked", "robots.txt forbids "), ("unread", "could not open "), ("in_part", "judged in part ")]
    warnings = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.concat(F.lit(t), F.col(c).cast("string"))) for c, t in said]))
    return out.withColumn("status", F.when((F.col("unread") + F.col("in_part")) > 0, "partial").otherwise("complete")).withColumn("warnings", warnings)


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, rows): how many rows break each rule; a rule that is unknown for a row is broken."""
    counted = rows.agg(*[F.count_if(~F.coalesce(r, F.lit(False))).alias(n) for n, r in rules.items()])
    return counted.unpivot([], list(rules), "rule", "rows")


def validated(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rows``, or an error that names the first rule broken."""
    broken = F.coalesce(*[F.when(~F.coalesce(r, F.lit(False)), F.raise_error(F.lit(f"invalid: {n}")).cast("boolean")) for n, r in rules.items()], F.lit(True))
    return rows.where(broken)


def estimate_run(results: int, candidates: int, pages: int) -> dict[str, int]:
    """Ceilings of a keyword run: searches, pages read, judgments."""
    return {"searches": 1 + candidates, "pages": min(pages, results), "judgments": 3 * min(pages, results) + candidates + 10 * candidates}


def estimate_audit(pages: int, questions: int, engines: int, engine_calls: int) -> dict[str, int]:
    each = engine_calls // engines if engines else 0
    return {"pages": pages, "judgments": 3 * pages + 3 * questions, "engine_calls": min(questions, each) * engines, "seed_searches": min(3, ceil(questions / 8) if questions else 0)}


def engine_rows(records: DataFrame, citations: DataFrame, own: str, most: int = 10) -> DataFrame:
    """(engine, asked, missing, cited_instead, searches, cost_micro): domains cited where we are
    missing, the most frequent first; the cost only if all of it is known."""
    figures = records.groupBy("engine").agg(
        F.count(F.lit(1)).alias("asked"), F.count_if(F.col("status") == "missing").alias("missing"), F.sum("searches").alias("searches"), F.when(F.count("cost_micro") == F.count(F.lit(1)), F.sum("cost_micro")).alias("cost_micro")
    )
    lost = citations.where(F.col("domain") != own).join(records.where("status = 'missing'").select("answer_id"), "answer_id", "left_semi").select("engine", "answer_id", "domain").distinct()
    best = top_per(lost.groupBy("engine", "domain").agg(F.count(F.lit(1)).alias("n")), ["engine"], [F.desc("n"), F.col("domain")], most, "place")
    instead = best.groupBy("engine").agg(F.sort_array(F.collect_list(F.struct("place", "domain"))).alias("i"))
    return figures.join(instead, "engine", "left").withColumn("cited_instead", F.coalesce(F.transform("i", lambda x: x["domain"]), F.array().cast("array<string>"))).drop("i")


def answer_record(answers: DataFrame, most: int = 500) -> DataFrame:
    """Answers as reports keep them, with an excerpt."""
    return answers.withColumn("excerpt", T.clip(F.col("text"), most)).drop("text")


def ai_share(records: DataFrame, citations: DataFrame) -> DataFrame:
    """(domain, share): of the answers that came, those that cite the domain."""
    came = records.where("status <> 'failed'").select("answer_id")
    total = came.agg(F.count(F.lit(1)).alias("all"))  # one row
    n = citations.join(came, "answer_id", "left_semi").select("answer_id", "domain").distinct().groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(total)).select("domain", (F.floor((F.col("n") * 2000 + F.col("all")) / (F.col("all") * 2)) / 1000.0).alias("share"))


def competitor_order(pages: DataFrame, most: int) -> DataFrame:
    """Pages to copy first, then by their score; unknown scores last."""
    order = [F.desc(F.col("verdict") == "steal"), F.desc(F.coalesce("overall", F.lit(0.0))), F.col("id")]
    return pages.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def element_order(verdicts: DataFrame, most: int) -> DataFrame:
    order = [F.desc("impact"), F.desc("confidence"), F.col("id"), F.col("element")]
    return verdicts.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))


#: The markup that a type of page should have.
EXPECTED_SCHEMA = {
    "service_page": "(?i)service|product|offer", "company_homepage": "(?i)organization|localbusiness|corporation|store|professionalservice", "ecommerce_product": "(?i)product|offer", "blog_article": "(?i)article|blogposting|newsarticle|howto",
}


def has_expected_schema(page_type: Column, types: Column) -> Column:
    """Null where a type of page has no markup of its own."""

    def any_like(pattern: str) -> Column:
        return F.exists(types, lambda t: t.rlike(pattern))

    return F.coalesce(*[F.when(page_type == name, any_like(pattern)) for name, pattern in EXPECTED_SCHEMA.items()])


def brief_summary(c: dict[str, Column]) -> Column:
    """A brief in one sentence, from target words, pages and dominant type."""
    return F.concat(F.lit("Write a "), F.replace(c["type"], F.lit("_"), F.lit(" ")), F.lit(" of about "), c["target"].cast("string"), F.lit(" words; "), c["pages"].cast("string"), F.lit(" pages were compared."))


def brief_checklist(c: dict[str, Column]) -> Column:
    rules = [
        (c["target"].isNotNull(), F.concat(F.lit("length "), c["least"].cast("string"), F.lit("-"), c["most"].cast("string"))), (c["starts"] >= 0.5, F.lit("keyword first in the title")),
        (c["terms"] > 0, F.concat(F.lit("cover "), c["terms"].cast("string"), F.lit(" terms"))), (c["questions"] > 0, F.lit("answer the questions")), (c["faq_share"] >= 0.4, F.lit("add questions with markup")),
    ]
    return F.array_compact(F.array(*[F.when(rule, said) for rule, said in rules]))


def weighted_criteria(spark) -> DataFrame:
    """(criterion, weight, place): by weight, of equals as declared."""
    rows = sorted(((k, float(w), i) for i, (k, w) in enumerate(W.CITABILITY.items())), key=lambda r: (-r[1], r[2]))
    return spark.createDataFrame([(k, w, i + 1) for i, (k, w, _) in enumerate(rows)], "criterion string, weight double, place int")


def plan_markdown(plans: DataFrame) -> DataFrame:
    """(place, text): a plan as Markdown, its texts escaped so that nothing in them turns into a link."""
    quiet = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[\r\n]+", " "), r"([\\`*_{}\[\]()#+|<>!~-])", r"\\$1"), r"(?i)(https?):", r"$1\\:")
    steps = F.array_join(F.transform("steps", lambda s: F.concat(F.lit("- [ ] "), quiet(s))), "\n")
    return plans.select("place", F.concat(F.lit("## "), quiet(F.col("title")), F.lit("\n\n"), steps, F.lit("\n")).alias("text"))
