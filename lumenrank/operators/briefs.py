"""Content briefs: how titles look, which schema types and proofs pages have, what ours lack."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..functions.numbers import ratio3
from .audit import GENERIC_SCHEMA
from .ranking import top_per


def title_patterns(titles: DataFrame) -> DataFrame:
    """(scope, pages, mean_length, starts): whole-number mean length and the share that opens with the keyword."""
    opens = T.starts_with_keyword(T.terms(F.col("title")), T.keyword_terms(F.col("keyword")))
    return titles.groupBy("scope").agg(
        F.count(F.lit(1)).alias("pages"), F.floor((F.sum(F.length("title")) * 2 + F.count(F.lit(1))) / (F.count(F.lit(1)) * 2)).alias("mean_length"), ratio3(F.count_if(opens), F.count(F.lit(1))).alias("starts")
    )


def title_words(titles: DataFrame, most: int = 6) -> DataFrame:
    """Words of four letters or more on two titles or more, that are not the keyword's."""
    words = F.array_distinct(F.filter(T.words(F.col("title")), lambda w: F.length(w) >= 4))
    each = titles.select("scope", F.explode(F.array_except(words, T.words(F.col("keyword")))).alias("word"))
    return top_per(each.groupBy("scope", "word").agg(F.count(F.lit(1)).alias("pages")).where("pages >= 2"), ["scope"], [F.desc("pages"), F.col("word")], most, "place")


def schema_types(pages: DataFrame, most: int = 8) -> DataFrame:
    """(scope, type, pages): distinct types of each page without the generic ones."""
    each = pages.select("scope", F.explode(F.array_distinct("types")).alias("type")).where(~F.col("type").isin(GENERIC_SCHEMA))
    return top_per(each.groupBy("scope", "type").agg(F.count(F.lit(1)).alias("pages")), ["scope"], [F.desc("pages"), F.col("type")], most)


def element_shares(pages: DataFrame, elements: list[str], sure: float = 0.6) -> DataFrame:
    """(scope, element, pages, share): of the judged pages those that have it, unpivoted."""
    long = pages.unpivot(["scope"], elements, "element", "p").where("p is not null")
    return long.groupBy("scope", "element").agg(F.count(F.lit(1)).alias("pages"), ratio3(F.count_if(F.col("p") >= sure), F.count(F.lit(1))).alias("share"))


def missing_terms(shared: DataFrame, own: DataFrame, least: float = 0.5, most: int = 8) -> DataFrame:
    """Terms that many pages share and ours lacks."""
    lacking = shared.where(F.col("share") >= least).join(own, ["scope", "term"], "left_anti")
    return top_per(lacking, ["scope"], [F.desc("share"), F.col("term")], most, "place")


def template_questions(seeds: DataFrame, templates: list[str]) -> DataFrame:
    """(ordinal, text): each seed in each template, seeds first. The templates are a constant."""
    filled = F.array(*[F.replace(F.lit(t), F.lit("{}"), F.col("seed")) for t in templates])
    each = seeds.select("ordinal", F.posexplode(filled).alias("nth", "text"))
    return each.select((F.col("ordinal") * len(templates) + F.col("nth")).alias("ordinal"), "text")


def best_excerpt(text: Column, terms: Column, most: int = 600) -> Column:
    """The sentence that covers the most of the terms, the first of equals, and the three after it."""
    sentences = F.filter(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.length(s) > 20)
    scored = F.transform(T.beside(T.nfkc_each(sentences), terms), lambda s, i: F.struct(F.size(F.array_intersect(s["1"], T.terms(s["0"], plain=True))).alias("n"), (-i).alias("less")))
    at = -F.array_max(scored)["less"]
    return F.when(F.size(sentences) > 0, F.left(F.array_join(F.slice(sentences, at + 1, F.lit(4)), " "), F.lit(most)))


def fit_title(title: Column, most: int = 62) -> Column:
    core = T.title_core(title)
    return F.when(F.length(title) <= most, title).when(F.length(core) <= most, core).otherwise(T.clip(core, most))


def brand_label(domain: Column) -> Column:
    return F.initcap(F.regexp_replace(F.substring_index(domain, ".", 1), "[-_.]+", " "))


def known_steps(done: Column, known: Column) -> Column:
    """Distinct known ids in the order given."""
    return F.array_intersect(done, known)


def baseline_steps(c: dict[str, Column]) -> Column:
    """The checklist of a plan, in order, at most twelve."""
    rules = [
        (c["action"] == "create", "create_page"), (c["action"] == "rewrite", "answer_first"), (c["words"] < c["target_words"], "extend"), (F.coalesce(c["faq"], F.lit(0.0)) < 0.5, "add_faq"), (F.coalesce(c["facts"], F.lit(0.0)) < 0.5, "add_facts"),
        (F.coalesce(c["sources"], F.lit(0.0)) < 0.5, "cite_sources"), (F.coalesce(c["author"], F.lit(0.0)) < 0.5, "name_author"), (F.coalesce(c["fresh"], F.lit(0.0)) < 0.5, "update"), (F.coalesce(c["compare"], F.lit(0.0)) < 0.5, "add_table"), (F.coalesce(c["links"], F.lit(0.0)) < 0.5, "link"),
    ]
    return F.slice(F.array_compact(F.array(*[F.when(r, F.lit(n)) for r, n in rules])), 1, 12)


def target_words(typical: Column, current: Column) -> Column:
    """To a hundred: the typical length, half more than now, 600 at least."""
    return (F.floor(F.greatest(F.coalesce(typical, F.lit(0.0)), F.coalesce(current, F.lit(0)) * 1.5, F.lit(600.0)) / 100 + 0.5) * 100).cast("long")


def first_json(text: str | None) -> str | None:
    """The first balanced JSON object or array in a text."""
    decoder, at = json.JSONDecoder(), 0
    while text and (found := min((i for i in (text.find("{", at), text.find("[", at)) if i >= 0), default=-1)) >= 0:
        try:
            return text[found : decoder.raw_decode(text, found)[1]]
        except (ValueError, RecursionError):
            at = found + 1
    return None


@F.arrow_udf(StringType())
def extract_json(texts: pa.Array) -> pa.Array:
    return pa.array([first_json(x) for x in texts.to_pylist()], pa.string())


def tokens(typed: Column) -> Column:
    """Distinct entries of a form field, split at commas, semicolons and white space."""
    return F.array_distinct(F.filter(F.split(F.trim(typed), r"(?U)[\s,;]+"), lambda x: x != ""))
