"""Why assistants leave us out, put together from answers, questions, pages and who won; and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import weights as W
from ..functions.numbers import ratio3, weighted
from . import audit
from .answers import skip_reasons
from .ranking import first_per


def action_for(reasons: Column, match: Column) -> Column:
    """A new page, or the old one anew? One with the wrong angle is a new page in all but name."""
    wrong = F.array_contains(reasons, "wrong_angle") & (F.coalesce(match, F.lit(0.0)) < 0.45)
    return F.when(F.array_contains(reasons, "no_page") | wrong, "create").otherwise("rewrite")


def citability_of(c: dict[str, Column]) -> Column:
    known = c["answer"].isNotNull() | c["facts"].isNotNull()
    return F.when(known, weighted([(c[k], w) for k, w in W.CITABILITY.items()]))


def why_cited(c: dict[str, Column]) -> Column:
    """At most six plain reasons that a page is cited; criteria and words, sources, types, age."""
    z = lambda k: F.coalesce(c[k], F.lit(0.0))
    rules = [
        (z("answer") >= 0.7, F.lit("answer first")), (z("faq") >= 0.8, F.lit("questions with markup")), (z("compare") >= 0.9, F.lit("comparison table")),
        ((z("fresh") >= 0.9) & c["age"].isNotNull(), F.concat(F.lit("updated "), F.greatest(F.lit(1), F.floor(c["age"] + 0.5)).cast("string"), F.lit(" months ago"))),
        (z("sources") >= 0.6, F.concat(F.lit("cites "), c["external"].cast("string"), F.lit(" sources"))), (z("facts") >= 0.7, F.lit("many facts")), (z("author") >= 0.7, F.lit("author and company named")),
        (c["words"] >= 1200, F.concat(F.lit("about "), (F.floor(c["words"] / 100 + 0.5) * 100).cast("string"), F.lit(" words"))),
        (audit.schema_richness(c["types"]) >= 0.75, F.concat(F.lit("markup: "), F.array_join(F.slice(c["types"], 1, 3), ", "))),
    ]
    return F.slice(F.array_compact(F.array(*[F.when(rule, said) for rule, said in rules])), 1, 6)


def winner_pages(cited: DataFrame, c: dict[str, Column]) -> DataFrame:
    """``cited`` with score10, why and the radar of six criteria; unread pages have none."""
    radar = F.struct(*[c[k].alias(n) for k, n in (("answer", "answer"), ("facts", "entity"), ("faq", "faq"), ("author", "author"), ("fresh", "fresh"), ("sources", "sources"))])
    return cited.withColumns({"score10": F.coalesce(audit.score10(citability_of(c)), F.lit(0.0)), "why": F.when(c["words"].isNotNull(), why_cited(c)).otherwise(F.array().cast("array<string>")), "radar": radar})


def assemble_skips(lost: DataFrame, questions: DataFrame, coverage: DataFrame, pages: DataFrame, first_cited: DataFrame, most: int | None = 150) -> DataFrame:
    """One row a lost answer (ordinal, answer_id, engine, question_id): the question, our page for it,
    who is cited instead, the reasons and what to do; the first ``most`` by ordinal (None: all).

    ``coverage`` is (question_id, best_page, match, angle, verdict); ``pages`` (url, words, age, fresh,
    answer, facts, author, sources); ``first_cited`` (answer_id, winner_domain, winner_words).
    """
    first = lost if most is None else lost.orderBy("ordinal").limit(most)
    own = F.when(F.col("verdict") != "no_page", F.col("best_page"))
    met = first.join(questions, "question_id").join(coverage.withColumn("our_url", own), "question_id", "left")
    met = met.join(pages.withColumnRenamed("url", "our_url").withColumn("has_page", F.lit(True)), "our_url", "left").join(first_cited, "answer_id", "left")
    has = F.coalesce("has_page", F.lit(False))
    c = {k: F.col(k) for k in ("words", "winner_words", "angle", "answer", "facts", "author", "age", "fresh", "sources")} | {"has_page": has}
    out = met.withColumn("exists", has).withColumn("reasons", skip_reasons(c))
    return out.withColumn("action", action_for(F.col("reasons"), F.col("match"))).select("ordinal", "answer_id", "engine", "question_id", "text", "our_url", "exists", "winner_domain", "reasons", "action", "match", "words")


def pseudo_skips(questions: DataFrame, coverage: DataFrame, pages: DataFrame, engine: str) -> DataFrame:
    """The questions that the site does not answer, as skips of a run without answers."""
    weak = questions.join(coverage.where("verdict <> 'answered'").select("question_id"), "question_id", "left_semi")
    lost = weak.select(F.col("question_id").alias("ordinal"), F.col("question_id").alias("answer_id"), F.lit(engine).alias("engine"), "question_id")
    none = lost.select("answer_id", F.lit(None).cast("string").alias("winner_domain"), F.lit(None).cast("int").alias("winner_words"))
    return assemble_skips(lost, questions, coverage, pages, none, None)


def plan_title(kind: Column, page_title: Column, url: Column, shortest: Column) -> Column:
    """Of a page its title, of a new one the shortest question without its mark; 160 characters."""
    asked = F.trim(F.regexp_replace(F.coalesce(shortest, F.lit("New page")), r"[?\s]+$", ""))
    new = F.concat(F.upper(F.left(asked, F.lit(1))), F.substr(asked, F.lit(2)))
    return F.left(F.when(kind == "rewrite", F.coalesce(page_title, url)).otherwise(new), F.lit(160))


def build_plans(skips: DataFrame, clusters: DataFrame, titles: DataFrame, engines: list[str], most: int = 12) -> DataFrame:
    """One plan a page to rewrite or cluster of questions to write for, the ``most`` that lose most.

    ``clusters`` is (text, cluster) of the questions that need a new page, ``titles`` (our_url, title).
    """
    create = (F.col("action") == "create") | F.col("our_url").isNull()
    keyed = skips.join(clusters, "text", "left").withColumn("kind", F.when(create, "create").otherwise("rewrite"))
    keyed = keyed.withColumn("key", F.when(create, F.concat(F.lit("new:"), F.coalesce(F.col("cluster").cast("string"), F.col("text")))).otherwise(F.concat(F.lit("page:"), F.col("our_url"))))
    total = skips.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("total"))  # one row
    asked = first_per(keyed, ["key", "text"], [F.col("ordinal")]).select("key", "text", "ordinal")
    shown = asked.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("ordinal"))).where("nth <= 8")
    listed = shown.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("nth", "text"))).alias("q"))
    shortest = asked.groupBy("key").agg(F.min_by("text", F.struct(F.length("text"), F.col("ordinal"))).alias("shortest"), F.count(F.lit(1)).alias("n_questions"))
    why = keyed.select("key", F.explode("reasons").alias("reason")).groupBy("key", "reason").agg(F.count(F.lit(1)).alias("n"))
    reasons = why.groupBy("key").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "reason"))).alias("r"))  # eight reasons at most
    main = keyed.groupBy("key", "kind").agg(F.count(F.lit(1)).alias("lost"), F.collect_set("engine").alias("e"), F.min("our_url").alias("our_url"), F.count_distinct("winner_domain").alias("winners"))
    order = [F.desc("lost"), F.desc("n_questions"), F.col("key")]
    best = main.join(shortest, "key").orderBy(*order).limit(most)
    out = best.join(listed, "key").join(reasons, "key", "left").join(titles, "our_url", "left").crossJoin(F.broadcast(total))
    title = plan_title(F.col("kind"), F.col("title"), F.col("our_url"), F.col("shortest"))
    fixed = F.filter(F.array(*[F.lit(x) for x in engines]), lambda x: F.array_contains("e", x))
    return out.withColumn("plan_title", title).select(
        F.row_number().over(Window.orderBy(*order)).alias("place"), "key", "kind", F.col("our_url").alias("url"), F.col("plan_title").alias("title"), "lost", "n_questions", "winners",
        F.when(F.col("kind") == "create", F.concat(F.lit("/"), T.file_slug(F.col("plan_title"), 50))).alias("path"), F.transform("q", lambda x: x["text"]).alias("questions"), fixed.alias("engines"),
        F.transform("r", lambda x: x["reason"]).alias("reasons"), ratio3(F.col("lost"), F.col("total")).alias("priority"),
    )
