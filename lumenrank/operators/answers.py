"""Answers of assistants: citations, mentions, shares with intervals, reasons for losing, plans."""

from __future__ import annotations

import math
import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U

from ..functions.numbers import r3, ratio3, wilson
from .ranking import top_per


def names_of(domain: Column) -> Column:
    """The domain, its first label, and the label with dashes as blanks and without; four letters or more."""
    label = F.substring_index(domain, ".", 1)
    return F.filter(F.array_distinct(F.array(domain, label, F.replace(label, F.lit("-"), F.lit(" ")), F.replace(label, F.lit("-"), F.lit("")))), lambda x: F.length(x) >= 4)


def first_mention(text: Column, name: Column) -> Column:
    """Position (from 1) of a name as a whole word in a lower-case text; null where it is not.
    Up to three letters may follow a Cyrillic name."""
    tail = F.when(name.rlike(r"\p{IsCyrillic}$"), r"\p{IsCyrillic}{0,3}").otherwise("")
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.lower(name), F.lit(r"\E"), tail, F.lit(r"(?![\p{L}\p{N}])"))
    head = F.regexp_instr(text, pattern)
    return F.nullif(head, F.lit(0))


def brand_table(brands: DataFrame) -> DataFrame:
    """(domain, own, names) of brands (domain, own): one row a registrable domain, ours if any of its
    rows is, with the names it goes by and its domains."""
    site = U.registrable(F.concat(F.lit("https://"), "domain"))
    named = brands.select(site.alias("domain"), "own", F.array_append(names_of(site), F.col("domain")).alias("names"))
    return named.groupBy("domain").agg(F.bool_or("own").alias("own"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"))


MENTION = "array<struct<domain: string, own: boolean, at: int>>"


def mentions(answers: DataFrame, brands: DataFrame, most_names: int = 10_000) -> DataFrame:
    """(answer_id, domain, own, at): each brand's first mention as a whole word, from 1; up to three
    letters may follow a Cyrillic name. Brands are a list of rules of at most ``most_names`` names,
    found in one pass over each answer however many they are."""
    rules = [(r.domain, r.own, n.lower()) for r in brand_table(brands).limit(most_names + 1).collect() for n in r.names]
    if len(rules) > most_names:
        raise ValueError(f"more than {most_names} names; pass a greater most_names")
    by_name: dict[str, list[tuple[str, bool]]] = {}
    for domain, own, name in rules:
        by_name.setdefault(name, []).append((domain, own))

    @F.arrow_udf(MENTION)
    def find(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("domain", pa.string()), ("own", pa.bool_()), ("at", pa.int32())]))
        search = ahocorasick.Automaton()
        for name, owners in by_name.items():
            search.add_word(name, (len(name), owners))
        search.make_automaton()
        cyrillic = lambda c: "\u0400" <= c <= "\u052f"
        out = []
        for text in texts.to_pylist():
            first: dict[tuple[str, bool], int] = {}
            low = (text or "").lower()
            for end, (size, owners) in search.iter(low) if by_name else ():
                start, after = end + 1 - size, end + 1
                if start and low[start - 1].isalnum():
                    continue
                if cyrillic(low[end]):
                    while after < len(low) and after - end <= 3 and cyrillic(low[after]):
                        after += 1
                if after < len(low) and low[after].isalnum():
                    continue
                for owner in owners:
                    first[owner] = min(first.get(owner, start + 1), start + 1)
            out.append([{"domain": d, "own": o, "at": at} for (d, o), at in sorted(first.items())])
        return pa.array(out, kind)

    return answers.select("answer_id", F.explode(find(F.col("text"))).alias("m")).select("answer_id", "m.domain", "m.own", "m.at")


def analyse(answers: DataFrame, citations: DataFrame, found: DataFrame) -> DataFrame:
    """(answer_id, status, position, share): cited by place among the distinct domains cited,
    else named by how many brands come before, else missing."""
    order = citations.groupBy("answer_id", "domain", "own").agg(F.min("ordinal").alias("first"))
    placed = order.withColumn("place", F.row_number().over(Window.partitionBy("answer_id").orderBy("first"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("answer_id")))
    cited = placed.where("own").groupBy("answer_id").agg(F.min("place").alias("c_place"), F.max("n").alias("n"))
    own = found.where("own").groupBy("answer_id").agg(F.min("at").alias("at"))
    before = found.join(own.withColumnRenamed("at", "own_at"), "answer_id").where("not own").groupBy("answer_id").agg(F.count_if(F.col("at") < F.col("own_at")).alias("before"), F.count(F.lit(1)).alias("others"))
    out = answers.select("answer_id").join(cited, "answer_id", "left").join(own, "answer_id", "left").join(before, "answer_id", "left")
    named = F.col("at").isNotNull()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        "answer_id", F.when(F.col("c_place").isNotNull(), "cited").when(named, "named").otherwise("missing").alias("status"),
        F.when(F.col("c_place").isNotNull(), F.col("c_place")).when(named, zero("before") + 1).cast("long").alias("position"),
        F.when(F.col("c_place").isNotNull(), ratio3(F.lit(1), F.col("n"))).when(named, ratio3(F.lit(1), zero("others") + 1)).otherwise(0.0).alias("share"),
    )


def summarize_engines(records: DataFrame) -> DataFrame:
    """One row an engine from (engine, answer_id, failed, status, tokens): counts and the interval
    of the share of answers that cite."""
    out = records.groupBy("engine").agg(
        F.count(F.lit(1)).alias("asked"), F.count_if(~F.col("failed")).alias("answered"), F.count_if("failed").alias("failed"),
        F.count_if(~F.col("failed") & (F.col("status") == "cited")).alias("citing"), F.count_if(~F.col("failed") & (F.col("status") == "missing")).alias("skipping"), F.sum("tokens").alias("tokens"),
    )
    return out.withColumn("w", wilson(F.col("citing"), F.col("answered"))).select("*", F.col("w.share").alias("rate"), F.col("w.low").alias("low"), F.col("w.high").alias("high")).drop("w")


def top_cited(citations: DataFrame, k: int = 10) -> DataFrame:
    """(engine, domain, answers, place): distinct domains by answers of the engine."""
    counted = citations.select("engine", "answer_id", "domain").distinct().groupBy("engine", "domain").agg(F.count(F.lit(1)).alias("answers"))
    return top_per(counted, ["engine"], [F.desc("answers"), F.col("domain")], k, "place")


def sentiment(recommended: Column, neutral: Column, discouraged: Column, not_mentioned: Column) -> Column:
    total = F.nullif(recommended + neutral + discouraged, F.lit(0.0))
    return F.when(not_mentioned <= 0.6, r3((recommended + neutral * 0.5) / total))


def estimate_cost(usage: DataFrame, prices: DataFrame, fees: dict[str, float]) -> DataFrame:
    """``usage`` with ``usd``: the longest id of the price list that is the model or its start
    before a dash, tokens in millions, searches at a fee; null without a price."""
    model = F.regexp_replace(F.lower(F.trim("model")), "^models/", "")
    heads = F.transform(F.sequence(F.lit(1), F.size(F.split(model, "-"))), lambda n: F.array_join(F.slice(F.split(model, "-"), F.lit(1), n), "-"))
    known = prices.groupBy("engine").agg(F.map_from_entries(F.collect_list(F.struct(F.lower("known").alias("known"), F.struct("input", "output")))).alias("prices"))
    joined = usage.join(known, "engine", "left")
    # a model's own heads are looked up in the engine's price list: no join by inequality
    best = F.try_element_at(F.filter(F.transform(heads, lambda h: F.try_element_at("prices", h)), lambda p: p.isNotNull()), F.lit(-1))
    fee = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in fees.items() for x in kv]), F.col("engine")), F.lit(0.0))
    usd = (F.col("input_tokens") * best["input"] + F.col("output_tokens") * best["output"]) / 1_000_000 + F.col("searches") * fee
    return joined.withColumn("usd", F.floor(usd * 10_000 + 0.5) / 10_000).drop("prices")


def plan_calls(questions: DataFrame, engines: list[str], budget: int) -> DataFrame:
    """(engine, question_id, ordinal): the first budget / engines questions for each engine."""
    each = budget // len(engines)
    first = questions.orderBy("ordinal").limit(each)
    return first.select(F.explode(F.array(*[F.lit(e) for e in engines])).alias("engine"), "question_id", "ordinal")


REASONS = ["no_page", "wrong_angle", "no_answer", "too_thin", "no_facts", "no_author", "stale", "weak_trust"]


def skip_reasons(c: dict[str, Column]) -> Column:
    """At most four reasons, the most severe first; without any the weakest of three criteria."""
    thin = (c["words"] < 350) | (c["words"] < c["winner_words"] * 0.6)
    rules = [
        (c["angle"] < 0.4, 1.2 - c["angle"], "wrong_angle"), (c["answer"] < 0.45, 1 - c["answer"], "no_answer"),
        (thin, F.coalesce(1 - c["words"] / F.nullif(c["winner_words"].cast("double"), F.lit(0.0)), F.lit(0.7)), "too_thin"), (c["facts"] < 0.4, 1 - c["facts"], "no_facts"), (c["author"] < 0.35, 1 - c["author"], "no_author"),
        ((c["age"] >= 18) | (c["fresh"] < 0.4), F.coalesce(1 - c["fresh"], F.lit(0.6)), "stale"),
    ]
    made = F.array_compact(F.array(*[F.when(rule, F.struct((-severity).alias("severity"), F.lit(i).alias("ord"), F.lit(name).alias("name"))) for i, (rule, severity, name) in enumerate(rules)]))
    weakest = F.array_min(F.array_compact(F.array(*[F.when(c[k].isNotNull(), F.struct(c[k].alias("v"), F.lit(i).alias("ord"), F.lit(n).alias("name"))) for i, (k, n) in enumerate((("answer", "no_answer"), ("facts", "no_facts"), ("sources", "weak_trust")))])))
    fallback = F.array(F.coalesce(weakest["name"], F.lit("too_thin")))
    picked = F.transform(F.slice(F.sort_array(made), 1, 4), lambda s: s["name"])
    return F.when(~c["has_page"], F.array(F.lit("no_page"))).when(F.size(made) > 0, picked).otherwise(fallback)


def coverage_candidates(questions: DataFrame, pages: DataFrame, least: float = 0.12) -> DataFrame:
    """(scope, question_id, url): the pairs that a term of the question names. In order of how many pages of
    the scope have them, a page that has none of the rarer terms can have of each of the others what the page with the most parts of it has; so a term
    that a page has ``part`` parts of counts only if these and what is behind it could reach ``least``."""
    q = questions.select("scope", "question_id", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    p = pages.select("scope", "url", F.explode("head").alias("term"), F.lit(7).alias("part")).unionByName(pages.select("scope", "url", F.explode("intro").alias("term"), F.lit(3).alias("part")))
    weights = p.distinct().groupBy("scope", "url", "term").agg(F.sum("part").alias("part"))
    common = weights.groupBy("scope", "term").agg(F.count(F.lit(1)).alias("df"), F.max("part").alias("most"))
    after = Window.partitionBy("scope", "question_id").orderBy(F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, -1)
    ranked = q.join(common, ["scope", "term"]).withColumn("behind", F.coalesce(F.sum("most").over(after), F.lit(0)))
    # overlap is parts / n / 10, rounded to thousandths
    needed = F.ceil(F.col("n") * (2 * math.ceil(least * 1000 - 1e-9) - 1) / F.lit(200.0))
    met = ranked.withColumn("needed", needed).join(weights, ["scope", "term"]).where("part + behind >= needed")
    return met.select("scope", "question_id", "url").distinct()


def coverage_pairs(questions: DataFrame, pages: DataFrame, least: float = 0.12, k: int = 3) -> DataFrame:
    """(question_id, url, overlap, place): the pages of a scope (a site) that share the most of a
    question's terms, seven parts by their head and three by their intro. Candidates come from ``coverage_candidates``, and each is
    counted once, from the terms of both."""
    near = coverage_candidates(questions, pages, least)
    asked = questions.select("scope", "question_id", "terms")
    whole = pages.groupBy("scope", "url").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("head", "intro")])
    both = near.join(asked, ["scope", "question_id"]).join(whole, ["scope", "url"])
    shared = lambda c: F.size(F.array_intersect("terms", c))
    met = both.select("question_id", "url", F.size("terms").alias("n"), (shared("head") * 7 + shared("intro") * 3).alias("parts"))
    overlap = F.floor((F.col("parts") * 200 + F.col("n")) / (F.col("n") * 2)) / F.lit(1000.0)
    scored = met.withColumn("overlap", overlap).where(F.col("overlap") >= least)
    return top_per(scored, ["question_id"], [F.desc("overlap"), F.col("url")], k, "place").select("question_id", "url", "overlap", "place")
