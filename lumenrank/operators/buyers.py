"""Buyers' questions: gathered, screened, dealt over stages, met with pages and with answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import weights as W
from ..functions.numbers import r3
from .ranking import first_per, round_robin, top_per

#: Questions made of a phrase, where nobody has asked one.
TEMPLATES = [
    "How much does {} cost?", "What are the best companies for {}?", "What should I know before ordering {}?", "How can I tell whether a company for {} is reliable?",
    "What should I compare when choosing a provider for {}?", "Which company for {} would you recommend?",
]


def seeds(pages: DataFrame, most: int = 3, words: int = 5) -> DataFrame:
    """(seed, phrase): the first different phrases of ``words`` words or fewer of pages (ordinal,
    importance, phrase), by importance."""
    short = pages.where(F.col("phrase").isNotNull() & (F.size(F.split("phrase", r"\s+")) <= words))
    best = short.groupBy("phrase").agg(F.min(F.struct((-F.col("importance")).alias("less"), "ordinal")).alias("o"))
    return best.orderBy("o", "phrase").limit(most).withColumn("seed", F.row_number().over(Window.orderBy("o", "phrase")) - 1).select("seed", "phrase")


def collect_questions(searches: DataFrame, written: DataFrame, chosen: DataFrame, templates: list[str] = TEMPLATES) -> DataFrame:
    """(text, source, ord): what searches (seed, kind, ordinal, text) for the seeds brought, kinds paa,
    related and suggest, then what was written (ordinal, text), then templates filled with the seeds.
    Of related searches and suggestions only those that ask something."""
    kind = F.when(F.col("kind") == "paa", 0).when(F.col("kind") == "related", 1).otherwise(2)
    asked = searches.join(chosen.select("seed"), "seed", "left_semi").where((F.col("kind") == "paa") | T.looks_like_question(F.col("text")))
    place = lambda part, a, b, c: F.struct(F.lit(part).alias("part"), a.cast("long").alias("a"), b.cast("long").alias("b"), c.cast("long").alias("c")).alias("ord")
    zero = F.lit(0)
    found = asked.select(T.as_question(F.col("text")).alias("text"), F.col("kind").alias("source"), place(0, F.col("seed"), kind, F.col("ordinal")))
    more = written.select(T.as_question(F.col("text")).alias("text"), F.lit("llm").alias("source"), place(1, F.col("ordinal"), zero, zero))
    filled = F.array(*[F.replace(F.lit(t), F.lit("{}"), F.lower("phrase")) for t in templates])
    made = chosen.select("seed", F.posexplode(filled).alias("nth", "text")).select("text", F.lit("template").alias("source"), place(2, F.col("seed"), F.col("nth"), zero))
    return found.unionByName(more).unionByName(made)


def source_rank(source: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in W.QUESTION_SOURCES]), source) - 1


def dedupe_questions(raw: DataFrame) -> DataFrame:
    """(key, text, source, ord): by keyword key the most trusted source, at the place of the first; of 10
    to 200 characters."""
    keyed = raw.where(F.length("text").between(10, 200)).withColumn("key", T.keyword_key(F.col("text"))).where("key <> ''")
    best = F.min_by(F.struct("text", "source"), F.struct(source_rank(F.col("source")), "ord"))
    return keyed.groupBy("key").agg(best.alias("q"), F.min("ord").alias("ord")).select("key", "q.text", "q.source", "ord")


def screen_questions(questions: DataFrame, judged: DataFrame) -> DataFrame:
    """With stage and relevance from judged (key, stage, relevance); unjudged ones stay, at the first
    stage and a half; those judged beside the point go."""
    known = F.col("stage").isin(W.STAGES)
    out = questions.join(judged, "key", "left")
    return out.withColumn("stage", F.when(known, F.col("stage")).otherwise("discover")).withColumn("relevance", F.coalesce(r3(F.col("relevance")), F.lit(0.5))).where(F.col("relevance") >= W.MIN_RELEVANCE)


def balance_questions(questions: DataFrame, count: int) -> DataFrame:
    """``count`` questions, a stage at a time, with their place."""
    stage_order = F.array_position(F.array(*[F.lit(s) for s in W.STAGES]), F.col("stage"))
    return round_robin(questions, "stage", stage_order, [source_rank(F.col("source")), F.desc("relevance"), F.col("ord")], count)


def with_volumes(questions: DataFrame, volumes: DataFrame, most: int | None = 200) -> DataFrame:
    """With the monthly searches of volumes (keyword, volume), for the first ``most`` by place (None: all)."""
    known = volumes.where("volume is not null").groupBy(F.lower(F.trim("keyword")).alias("v_key")).agg(F.max("volume").alias("volume"))
    asked = F.lower(F.trim("text")) if most is None else F.when(F.col("place") <= most, F.lower(F.trim("text")))
    return questions.join(known, asked == F.col("v_key"), "left").drop("v_key")


def verdict_of(match: Column) -> Column:
    return F.when(match < W.WEAK_BELOW, "no_page").when(match < W.ANSWERED_AT, "weak").otherwise("answered")


def next_step(stage: Column, verdict: Column, angle: Column, answer_first: Column) -> Column:
    """What to do about a question: a new page, the angle, the top of the page, then the stage's usual gap."""
    return (
        F.when(verdict == "answered", "none")
        .when(verdict == "no_page", F.when(stage == "compare", "write_versus").when(stage == "local", "add_local").otherwise("write_guide"))
        .when(angle < 0.4, F.when(stage == "compare", "write_versus").otherwise("write_guide")).when(answer_first < 0.5, "answer_at_top")
        .when(stage == "trust", "add_proof").when(stage == "price", "add_prices").when(stage == "local", "add_local").otherwise("answer_at_top")
    )


def check_coverage(questions: DataFrame, candidates: DataFrame, judged: DataFrame, pages: DataFrame) -> DataFrame:
    """(question_id, best_page, match, angle, verdict, next_step, judged): of a question's candidates
    (question_id, url, overlap) the one that answers best by judged (question_id, url, answer, angle),
    then by overlap. Without a candidate there is no page; without any judgment the overlap decides
    and the result says so. ``pages`` is (url, answer_first)."""
    met = candidates.join(judged, ["question_id", "url"], "left")
    best = first_per(met, ["question_id"], [F.desc_nulls_last("answer"), F.desc("overlap"), F.col("url")]).join(pages, "url", "left")
    out = questions.select("question_id", "stage").join(best, "question_id", "left")
    known = F.col("answer").isNotNull()
    match = F.when(F.col("url").isNull(), 0.0).otherwise(r3(F.col("answer")))
    verdict = F.when(F.col("url").isNull(), "no_page").when(known, verdict_of(r3(F.col("answer")))).when(F.col("overlap") >= 0.5, "weak").otherwise("no_page")
    out = out.withColumns({"match": match, "verdict": verdict, "judged": F.col("url").isNull() | known, "angle": r3(F.when(known, F.col("angle")))})
    step = next_step(F.col("stage"), F.col("verdict"), F.col("angle"), F.col("answer_first"))
    return out.select("question_id", F.when(F.col("verdict") != "no_page", F.col("url")).alias("best_page"), "match", "angle", "verdict", step.alias("next_step"), "judged")


def question_citations(records: DataFrame, citations: DataFrame, most: int = 4) -> DataFrame:
    """(question_id, ai_cites, cited_by): of the answers that came (answer_id, question_id, engine,
    status), the domains of others most answers cite, and the engines that cite or name us."""
    came = records.where("status <> 'failed'")
    each = came.select("answer_id", "question_id").join(citations.where("not own").select("answer_id", "domain").distinct(), "answer_id")
    counted = top_per(each.groupBy("question_id", "domain").agg(F.count(F.lit(1)).alias("n")), ["question_id"], [F.desc("n"), F.col("domain")], most, "place")
    cites = counted.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("place", "domain"))).alias("c"))
    ours = came.groupBy("question_id").agg(F.sort_array(F.collect_set(F.when(F.col("status") != "missing", F.col("engine")))).alias("cited_by"))
    empty = F.array().cast("array<string>")
    return ours.join(cites, "question_id", "left").select("question_id", F.coalesce(F.transform("c", lambda x: x["domain"]), empty).alias("ai_cites"), "cited_by")


def merge_questions(asked: DataFrame, headings: DataFrame, most: int = 12) -> DataFrame:
    """(scope, text, place): what people also ask, then headings that ask, each key once, the first
    ``most`` of a scope. Both are (scope, ordinal, text)."""
    both = asked.withColumn("part", F.lit(0)).unionByName(headings.where(T.looks_like_question(F.col("text"))).withColumn("part", F.lit(1)))
    one = first_per(both.withColumn("key", T.keyword_key(F.col("text"))).where("key <> ''"), ["scope", "key"], [F.col("part"), F.col("ordinal")])
    return top_per(one, ["scope"], [F.col("part"), F.col("ordinal")], most, "place").select("scope", "text", "place")
