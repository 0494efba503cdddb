"""Keyword ideas from six sources, their results and volumes; what is known of a seed's results."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ranking import merge_by_key, ordered_union, top_per

#: Words that vary a phrase, and cities, by market.
CITIES = [
    "софия", "пловдив", "варна", "бургас", "русе", "стара загора", "плевен", "добрич", "сливен", "шумен",
    "перник", "хасково", "ямбол", "пазарджик", "благоевград", "велико търново", "враца", "габрово", "видин", "монтана",
]
MODIFIERS = {
    "bg": (["цена", "цени", "оферта", "за малък бизнес", "от нулата", "отзиви", "сравнение", "евтино", "онлайн", *CITIES[:6]], ["колко струва", "цена на", "фирма за", "агенция за", "услуги за"]),
    "en": (["price", "cost", "agency", "company", "services", "for small business", "near me", "quote", "cheap", "sofia"], ["best", "cheap", "hire"]),
}


def clean_keyword(s: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(s, r"[?!]+$", ""), r"(?U)\s+", " ")))


def has_local_modifier(keyword: Column, cities: list[str] = CITIES) -> Column:
    """Whether a keyword names a city, inflected or not. The cities' stems are worked out once, and of a keyword's words only those are stemmed
    whose first letters one of them has, which no stem loses but by a synonym."""
    folded = F.trim(F.regexp_replace(T.fold_spellings(keyword), r"[^\p{L}\p{N}]+", " "))
    whole = F.concat(F.lit(" "), folded, F.lit(" ")).rlike(" (?:" + "|".join(re.escape(c) for c in cities) + ") ") if cities else F.lit(False)
    stems = sorted({T.stem_word(c) for c in cities if " " not in c})
    heads = sorted({x[:2] for x in stems} | {w[:2] for w, same in T.SYNONYMS.items() if same in stems})
    inflected = F.filter(T.words(keyword), lambda w: F.left(w, F.lit(2)).isin(heads))
    return whole | F.exists(inflected, lambda w: T.stem(w).isin(stems))


def variations(spark: SparkSession, seed: str, market: str) -> DataFrame:
    """(ordinal, text): the seed with the market's words behind and before it."""
    suffix, prefix = MODIFIERS[market]
    made = [f"{seed} {m}" for m in suffix] + [f"{m} {seed}" for m in prefix]
    return spark.createDataFrame(list(enumerate(made)), "ordinal long, text string")


def generate_candidates(seed: str, related: DataFrame, asked: DataFrame, suggested: DataFrame, topics: DataFrame, title_words: DataFrame, phrases: DataFrame, market: str, most: int = 80) -> DataFrame:
    """(key, keyword, sources, pages, place): ideas merged by keyword key, the first spelling at the first
    place, the first ``most``; of 2 to 9 words and 80 characters, other than the seed.

    The first three are (ordinal, text). ``topics`` (ordinal, text, pages) count from two pages on if
    they share a term with the seed; ``title_words`` (ordinal, text, pages) of four letters go behind
    the seed; of ``phrases`` (ordinal, text, pages) the first ten that have all its terms and more.
    """
    own = F.array_distinct(T.keyword_terms(F.lit(seed)))
    terms = T.keyword_terms(F.col("text"))
    none = F.lit(0).cast("long").alias("pages")
    parts = [df.select("ordinal", "text", none, F.lit(s).alias("source")) for df, s in ((related, "related"), (asked, "people_also_ask"), (suggested, "autocomplete"))]
    parts.append(topics.where((F.col("pages") >= 2) & F.arrays_overlap(terms, own)).select("ordinal", "text", "pages", F.lit("competitor_terms").alias("source")))
    words = title_words.where((F.length("text") >= 4) & ~F.arrays_overlap(F.transform(T.words(F.col("text")), T.stem), own))
    parts.append(words.select("ordinal", F.concat(F.lit(seed + " "), "text").alias("text"), "pages", F.lit("competitor_terms").alias("source")))
    whole = phrases.where((F.size(F.array_except(own, terms)) == 0) & (F.size(F.array_distinct(terms)) > F.size(own))).orderBy("ordinal").limit(10)
    parts.append(whole.select("ordinal", "text", "pages", F.lit("competitor_terms").alias("source")))
    parts.append(variations(related.sparkSession, seed, market).select("ordinal", "text", none, F.lit("modifier").alias("source")))
    both = ordered_union(parts).withColumn("text", clean_keyword(F.col("text"))).withColumn("key", T.keyword_key(F.col("text")))
    fit = both.where(F.size(F.split("text", " ")).between(2, 9) & (F.length("text") <= 80) & (F.col("key") != "") & (F.col("key") != T.keyword_key(F.lit(seed))))
    pages = fit.groupBy("key").agg(F.max("pages").alias("pages"))
    merged = merge_by_key(fit, "key", "text", "source").join(pages, "key")
    return merged.orderBy("ord").limit(most).select("key", F.col("text").alias("keyword"), "sources", "pages", F.row_number().over(Window.orderBy("ord")).alias("place"))


def candidate_results(picked: DataFrame, results: DataFrame, judged: DataFrame, failed: DataFrame, top: int = 10) -> DataFrame:
    """(keyword, results, judged, failed): the first results of each picked keyword with their shallow
    judgments (keyword, url, page_type); a search that failed is counted."""
    met = top_per(picked.select("keyword").join(results, "keyword"), ["keyword"], [F.col("position"), F.col("url")], top)
    shallow = met.join(judged, ["keyword", "url"], "left").groupBy("keyword").agg(F.count(F.lit(1)).alias("results"), F.count("page_type").alias("judged"))
    out = picked.select("keyword").join(shallow, "keyword", "left").join(failed.select("keyword").distinct().withColumn("failed", F.lit(True)), "keyword", "left")
    return out.select("keyword", F.coalesce("results", F.lit(0)).alias("results"), F.coalesce("judged", F.lit(0)).alias("judged"), F.coalesce("failed", F.lit(False)).alias("failed"))


def crawl_targets(targets: DataFrame, pages: DataFrame, budget: int | None) -> DataFrame:
    """Targets (ordinal, url) with what came of reading them (url, status); beyond the budget skipped,
    within it unread if nothing came."""
    met = targets.join(pages, "url", "left")
    if budget is None:
        return met.withColumn("status", F.coalesce("status", F.lit("error")))
    inside = targets.orderBy("ordinal").limit(budget).select("url").withColumn("inside", F.lit(True))
    return met.join(inside, "url", "left").withColumn("status", F.when(F.col("inside"), F.coalesce("status", F.lit("error"))).otherwise("skipped")).drop("inside")


def seed_signals(results: DataFrame, deep: DataFrame, shallow: DataFrame) -> DataFrame:
    """Results (url, title_match) with the judgment of the page where it was read, else of the result
    alone: deep (url, page_type, dedicated, depth, title_coverage), shallow (url, page_type, dedicated)."""
    d = deep.select("url", *[F.col(c).alias(f"d_{c}") for c in ("page_type", "dedicated", "depth", "title_coverage")])
    s = shallow.select("url", *[F.col(c).alias(f"s_{c}") for c in ("page_type", "dedicated")])
    out = results.join(d, "url", "left").join(s, "url", "left")
    return out.select(
        "url", F.coalesce("d_page_type", "s_page_type").alias("page_type"), F.coalesce("d_dedicated", "s_dedicated").alias("dedicated"), F.col("d_depth").alias("depth"), F.coalesce("d_title_coverage", "title_match").alias("title_match"), F.col("d_page_type").isNotNull().alias("deep")
    )


def intent_agrees(intent: Column, dominant: Column) -> Column:
    """Null where either is unknown."""
    return intent == dominant
