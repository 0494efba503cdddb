"""Judging pages, keywords and results: what is asked of which page, in which state, and what came.

The judge is a service outside the query path: requests go out as a table, answers come back as one
(``asked``). ``offline`` answers by plain rules over facts, for runs without it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draws
from ..functions import text as T
from ..functions.numbers import clamp01, r3
from . import judgments as J

#: What can be asked (set, question, kind of answer, levels of a score).
QUESTIONS = [
    ("identity", "page_type", "choice", 0), ("identity", "intent_served", "choice", 0), ("identity", "targets_query", "noul", 0), ("identity", "local_to_market", "noul", 0),
    ("content", "topic_depth", "score", 5), ("content", "need_satisfied", "score", 4), ("content", "generic_content", "noul", 0),
    ("trust", "states_prices", "noul", 0), ("trust", "shows_portfolio", "noul", 0), ("trust", "shows_reviews", "noul", 0), ("trust", "clear_cta", "noul", 0), ("trust", "shows_identity", "noul", 0),
    ("keyword", "relevant_to_business", "noul", 0), ("keyword", "query_intent", "choice", 0), ("keyword", "commercial_value", "score", 4),
    ("shallow", "page_type", "choice", 0), ("shallow", "targets_query", "noul", 0),
    ("element", "title_clear", "noul", 0), ("element", "title_specific", "noul", 0), ("element", "meta_inviting", "noul", 0), ("element", "h1_matches", "noul", 0), ("element", "intro_direct", "noul", 0), ("element", "outline_logical", "score", 5),
    ("faq", "faq_useful", "noul", 0), ("citability", "answer_first", "score", 5), ("citability", "specific_facts", "score", 5), ("citability", "cites_sources", "noul", 0),
    ("cover", "answers_question", "score", 5), ("cover", "angle_fits", "noul", 0), ("buyer", "relevant_to_business", "noul", 0), ("buyer", "question_stage", "choice", 0), ("sentiment", "recommendation", "choice", 0),
]
PAGE_SETS = ("identity", "content", "trust")
FATAL = ("auth", "quota")


def question_dim(spark: SparkSession) -> DataFrame:
    """(set, question_id, kind, levels, ordinal)."""
    return spark.createDataFrame([(*q, i) for i, q in enumerate(QUESTIONS)], "set string, question_id string, kind string, levels int, ordinal int")


def applicable(m: dict[str, Column]) -> Column:
    """The element questions that apply to a page: what is missing is a rule, not a question."""
    rules = [
        (F.coalesce(m["title"], F.lit("")) != "", "title_clear"), (F.coalesce(m["title"], F.lit("")) != "", "title_specific"), (F.coalesce(m["description"], F.lit("")) != "", "meta_inviting"), (m["h1"] > 0, "h1_matches"),
        (F.length(F.trim(m["intro"])) >= 60, "intro_direct"), ((m["words"] >= 300) & (m["h2"] > 0), "outline_logical"), (m["faq"] > 0, "faq_useful"),
    ]
    return F.array_compact(F.array(*[F.when(rule, F.lit(q)) for rule, q in rules]))


def states(m: dict[str, Column], phrase: Column, market: str) -> dict[str, Column]:
    """What is sent for each set, clipped: small, so that equal pages are asked once."""
    base = [phrase.alias("search_query"), F.lit(market).alias("market")]
    title, description = T.clip(m["title"], 200).alias("title"), T.clip(m["description"], 300).alias("description")
    return {
        "identity": F.struct(*base, m["url"].alias("url"), title, description, T.clip(m["h1_text"], 200).alias("h1"), T.clip(m["intro"], 600).alias("intro")),
        "content": F.struct(phrase.alias("search_query"), title, F.slice(m["headings"], 1, 20).alias("outline"), m["words"].alias("words"), T.clip(m["body"], 1500).alias("sample")),
        "trust": F.struct(phrase.alias("search_query"), F.slice(m["prices"], 1, 5).alias("prices"), F.slice(m["ctas"], 1, 5).alias("ctas"), m["contact"].alias("contact"), m["proof"].alias("proof")),
        "element": F.struct(title, description, T.clip(m["h1_text"], 200).alias("h1"), T.clip(m["intro"], 500).alias("first_paragraph"), F.slice(m["headings"], 1, 20).alias("outline")),
        "citability": F.struct(phrase.alias("question"), T.clip(m["intro"], 900).alias("opening"), T.clip(m["body"], 1500).alias("sample")),
    }


def requests(pages: DataFrame, id_col: str, state: Column, questions: Column) -> DataFrame:
    """(id, request, state): pages with the same state share a request, which is sent once."""
    sent = pages.select(F.col(id_col).alias("id"), F.to_json(state).alias("state"), F.array_join(questions, ",").alias("questions"))
    return sent.withColumn("request", F.sha1(F.concat_ws("\n", "state", "questions")))


#: What ends the name of a question asked the other way round.
REVERSED = "__rev"


def wired(sent: DataFrame, choices: dict[str, list[str]], debias: list[str] | None = None, shuffle: bool = False) -> DataFrame:
    """(id, question_id, wire_id, options) of ``sent(id, state)``: each choice as it is asked, its options in order, or shuffled by a seed of
    state and question; those of ``debias`` a second time, under another name, with the options reversed."""
    if any(q.endswith(REVERSED) for q in choices):
        raise ValueError(f"no question's name may end in {REVERSED}")
    asks = F.array(*[F.struct(F.lit(q).alias("question_id"), F.array(*[F.lit(o) for o in options]).alias("options"), F.lit(q in (debias or [])).alias("twice")) for q, options in choices.items()])
    each = sent.select("id", "state", F.explode(asks).alias("q")).select("id", "state", "q.*")
    if shuffle:
        each = each.withColumn("options", draws.seeded_shuffle(F.col("options"), draws.fnv1a(F.col("state")).bitwiseXOR(draws.fnv1a(F.col("question_id")))))
    forward = F.struct(F.col("question_id").alias("wire_id"), F.col("options"))
    back = F.when(F.col("twice"), F.struct(F.concat("question_id", F.lit(REVERSED)).alias("wire_id"), F.reverse("options").alias("options")))
    return each.select("id", "question_id", F.explode(F.array_compact(F.array(forward, back))).alias("w")).select("id", "question_id", "w.*")


def unbiased(asked_: DataFrame, came: DataFrame) -> DataFrame:
    """(id, question_id, value, p, runner_up, confidence, failed) of ``wired`` and the answers (id, wire_id, probs): the mean of both ways of asking,
    of equal options the first as asked. If either answer did not come, nor did the whole one."""
    met = asked_.join(came.select("id", "wire_id", "probs"), ["id", "wire_id"], "left")
    raw = F.transform("options", lambda o: F.coalesce(F.try_element_at("probs", o), F.lit(0.0)))
    clean = F.transform(raw, lambda x: F.when(F.isnan(x) | (x < 0) | (x == float("inf")), 0.0).otherwise(x))
    total = F.aggregate("clean", F.lit(0.0), lambda a, x: a + x)
    # in the order of the question as it is: the twin's the other way round
    shares = F.transform("clean", lambda x: F.when(F.col("total") > 0, x / F.col("total")).otherwise(1.0 / F.size("clean")))
    even = met.withColumn("clean", clean).withColumn("total", total).withColumn("twin", F.col("wire_id") != F.col("question_id"))
    even = even.withColumn("shares", F.when(F.col("probs").isNotNull(), F.when(F.col("twin"), F.reverse(shares)).otherwise(shares)))
    both = even.groupBy("id", "question_id").agg(
        F.first(F.when(~F.col("twin"), F.col("options")), ignorenulls=True).alias("options"), F.first(F.when(~F.col("twin"), F.col("shares")), ignorenulls=True).alias("one"),
        F.first(F.when(F.col("twin"), F.col("shares")), ignorenulls=True).alias("two"), F.bool_or(F.col("shares").isNull()).alias("failed"),
    )
    mean = F.when(~F.col("failed"), F.zip_with("one", F.coalesce("two", "one"), lambda a, b: (a + b) / 2))
    ranked = F.sort_array(F.transform(mean, lambda w, i: F.struct((-w).alias("less"), i.alias("ord"), F.get("options", i).alias("name"))))
    n = F.size("options")
    top = -F.get("ranked", F.lit(0))["less"]
    sure = F.when(n > 1, (top - 1.0 / n) / (1 - 1.0 / n)).otherwise(1.0)
    return both.withColumn("ranked", ranked).select(
        "id", "question_id", F.get("ranked", F.lit(0))["name"].alias("value"), r3(top).alias("p"), F.get("ranked", F.lit(1))["name"].alias("runner_up"), F.when(~F.col("failed"), r3(clamp01(sure))).alias("confidence"), "failed"
    )


def asked(sent: DataFrame, came: DataFrame) -> DataFrame:
    """Requests with their answers (request, answer, error): an answer that failed for a time is null
    with its error; a failure that no retry can mend ends the query."""
    fatal = F.when(F.col("error").isin(*FATAL), F.raise_error(F.concat(F.lit("the judge refuses: "), F.col("error"))).cast("string"))
    out = sent.join(came, "request", "left")
    return out.withColumn("answer", F.coalesce(fatal, F.when(F.col("error").isNull(), F.col("answer")))).withColumn("failed", F.col("error").isNotNull())


def lite(kind: Column, value: Column, p: Column, confidence: Column) -> Column:
    """What reports keep of an answer, rounded."""
    return F.struct(kind.alias("kind"), value.alias("value"), r3(p).alias("p"), r3(confidence).alias("confidence"))


def judged_pages(answers: DataFrame) -> DataFrame:
    """One row a page: the twelve judgments of the three slices, and how whole they are."""
    return J.wide(answers, [q for s, q, _, _ in QUESTIONS if s in PAGE_SETS])


def judged_keywords(keywords: DataFrame, answers: DataFrame) -> DataFrame:
    """Keywords screened by (keyword, relevance, intent, commercial): what was not judged goes."""
    return keywords.join(answers.where("relevance is not null"), "keyword")


def cost(usage: DataFrame, price_per_million: float | None) -> DataFrame:
    """(calls, input_tokens, usd); without a price the cost is unknown."""
    usd = F.lit(None).cast("double") if price_per_million is None else F.sum("input_tokens") * F.lit(price_per_million) / 1_000_000
    return usage.agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), usd.alias("usd"))


def offline(m: dict[str, Column], phrase: Column) -> dict[str, Column]:
    """Answers by plain rules over facts, each a share from 0 to 1: the default without a judge.

    ``m`` has title, description, h1_text, intro, words, h2, prices, ctas, contact, proof, identity,
    lists, tables, external_domains (counts, texts and flags).
    """
    kw = T.keyword_terms(F.coalesce(phrase, F.lit("")))
    have = lambda s: T.coverage(kw, T.terms(F.coalesce(s, F.lit(""))))
    flag = lambda c, yes=0.85, no=0.15: F.when(c, yes).otherwise(no)
    depth = clamp01(m["words"] / F.lit(1500.0)) * 0.7 + clamp01(m["h2"] / F.lit(8.0)) * 0.3
    numbers = F.size(F.regexp_extract_all(F.coalesce(m["intro"], F.lit("")), F.lit(r"(\d+)"), F.lit(1)))
    n = F.length(F.coalesce(m["title"], F.lit("")))
    out = {
        "targets_query": have(m["title"]) * 0.5 + have(m["h1_text"]) * 0.3 + have(m["intro"]) * 0.2,
        "topic_depth": depth, "need_satisfied": depth * 0.6 + have(m["intro"]) * 0.4, "generic_content": 1 - clamp01((numbers + m["lists"] + m["tables"]) / F.lit(6.0)) * 0.8 - 0.1,
        "states_prices": flag(m["prices"] > 0), "shows_portfolio": flag(m["proof"] > 1), "shows_reviews": flag(m["proof"] > 0), "clear_cta": flag(m["ctas"] > 0), "shows_identity": flag(m["identity"] | m["contact"]),
        "title_clear": flag(n.between(25, 62)), "title_specific": flag(T.for_compare(m["title"]) != "home", 0.8, 0.2), "meta_inviting": F.when(F.length(m["description"]) >= 70, 0.75).when(m["description"].isNotNull(), 0.45), "h1_matches": F.when(m["h1_text"].isNotNull(), have(m["h1_text"])),
        "intro_direct": F.when(F.length(m["intro"]) >= 60, have(m["intro"]) * 0.6 + flag(numbers > 0, 0.4, 0.1)), "outline_logical": F.when(m["h2"] > 0, clamp01(m["h2"] / F.lit(6.0))),
        "answer_first": F.when(m["words"] > 0, have(m["intro"]) * 0.7 + 0.15), "specific_facts": F.when(m["words"] > 0, clamp01(numbers / F.lit(5.0)) * 0.8 + 0.1), "cites_sources": flag(m["external_domains"] >= 2, 0.75, 0.2),
    }
    return {k: r3(clamp01(v)) for k, v in out.items()}
