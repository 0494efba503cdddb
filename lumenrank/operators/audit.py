"""Whole-site audit: optimisation and composite scores, criteria, citability, element verdicts,
signals, competitor pages. Column expressions over page facts and judgments; null is unknown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import weights as W
from ..functions.numbers import clamp01, r3, weighted

GENERIC_SCHEMA = ["WebPage", "WebSite", "Organization", "BreadcrumbList", "ListItem", "ImageObject", "SearchAction", "Person", "PostalAddress"]


def _flag(b: Column) -> Column:
    return F.when(b.isNotNull(), F.when(b, 1.0).otherwise(0.0))


def optimization_score(m: dict[str, Column]) -> Column:
    """Fourteen weighted checks of a page against its keyword."""
    n, d = F.length(m["title"]), F.coalesce(F.length(m["description"]), F.lit(0))
    alt = F.when(m["images"] == 0, 0.5).otherwise(m["images_alt"] / F.nullif(m["images"].cast("double"), F.lit(0.0)))
    parts = [
        (m["title_coverage"], 0.18), (_flag(m["in_h1"]), 0.14), (F.when(n.between(25, 65), 1.0).when(n.between(15, 24) | n.between(66, 80), 0.5).otherwise(0.0), 0.06),
        (F.when(d.between(70, 170), 1.0).when(d > 0, 0.5).otherwise(0.0), 0.08), (_flag(m["h1"] == 1), 0.06), (clamp01(m["h2"] / F.lit(4.0)), 0.1), (_flag(m["in_url"]), 0.04), (_flag(m["in_meta"]), 0.04),
        (_flag(m["has_schema"]), 0.08), (alt, 0.05), (F.when(m["canonical_self"], 1.0).when(m["canonical_self"].isNull(), 0.3).otherwise(0.0), 0.04), (_flag(m["viewport"]), 0.04), (_flag(m["https"]), 0.04), (_flag(~m["noindex"]), 0.05),
    ]
    return weighted(parts)


def composite_scores(j: dict[str, Column], optimization: Column, peer_median: Column | None = None) -> dict[str, Column]:
    """content, trust, conversion and overall from judgments and facts."""
    target = F.greatest(F.lit(300.0), F.coalesce(peer_median, F.lit(1200.0)) if peer_median is not None else F.lit(1200.0))
    length = F.least(F.lit(1.0), j["words"] / target)
    content = weighted([(j["depth"], W.CONTENT["depth"]), (j["need"], W.CONTENT["need"]), (1 - j["generic"], W.CONTENT["specific"]), (length, W.CONTENT["length"])])
    trust = weighted([(j["portfolio"], W.TRUST["portfolio"]), (j["reviews"], W.TRUST["reviews"]), (j["identity"], W.TRUST["identity"]), (_flag(j["contact"]), W.TRUST["contact"])])
    conversion = weighted([(j["cta"], W.CONVERSION["cta"]), (j["prices"], W.CONVERSION["prices"]), (_flag(j["form"]), W.CONVERSION["form"]), (_flag(j["contact"]), W.CONVERSION["contact"])])
    overall = weighted([(content, W.OVERALL["content"]), (optimization, W.OVERALL["optimization"]), (trust, W.OVERALL["trust"]), (conversion, W.OVERALL["conversion"])])
    return {"content": content, "trust": trust, "conversion": conversion, "overall": overall}


def age_months(modified: Column, published: Column, latest_year: Column, now: Column) -> Column:
    """To one decimal from a date; from a year alone the year's difference and a quarter; never below 0."""
    at = F.coalesce(modified, published)
    exact = F.floor((F.unix_timestamp(now) - F.unix_timestamp(at)) / F.lit(86400 * 30.44) * 10 + 0.5) / 10
    return F.greatest(F.lit(0.0), F.when(at.isNotNull(), exact).otherwise((F.year(now) - latest_year) * 12.0 + 3))


def freshness(months: Column) -> Column:
    ramp = 1 - (months - W.FRESH_MONTHS) / (W.STALE_MONTHS - W.FRESH_MONTHS) * (1 - W.FRESH_FLOOR)
    return F.when(months <= W.FRESH_MONTHS, 1.0).when(months >= W.STALE_MONTHS, W.FRESH_FLOOR).otherwise(r3(ramp))


def schema_richness(types: Column) -> Column:
    n = F.size(F.array_distinct(F.transform(types, lambda t: F.lower(t))))
    return F.when(n == 0, 0.0).when(n == 1, 0.45).when(n == 2, 0.75).otherwise(1.0)


def criteria(f: dict[str, Column]) -> dict[str, Column]:
    """The eight criteria of how citable a page is; answer and facts as judged."""
    hints = reduce(lambda a, b: a + b, [F.when(f[c], 0.25).otherwise(0.0) for c in ("author_hint", "registration", "address", "about_link")])
    linked = clamp01(f["external_domains"] / F.lit(4.0))
    return {
        "answer": f["answer"], "facts": f["facts"],
        "sources": r3(F.when(f["cites"].isNull(), linked).otherwise((linked + f["cites"]) / 2)),
        "author": r3(F.when(f["identity"].isNull(), clamp01(hints * 0.7 + 0.15)).otherwise(hints * 0.5 + f["identity"] * 0.5)),
        "faq": F.when(f["faq_schema"], F.when((f["faq_questions"] >= 3) | (f["faq_questions"] == 0), 1.0).otherwise(0.8)).when(f["faq_section"], 0.55).when(f["question_heads"] >= 2, 0.4).otherwise(0.0),
        "fresh": freshness(f["age_months"]),
        "compare": F.when(f["tables"] > 0, 1.0).when(f["lists"] >= 3, 0.7).when(f["lists"] >= 1, 0.4).otherwise(0.1),
        "links": r3(clamp01(f["links_in"] / F.greatest(F.lit(6.0), f["words"] / F.lit(150.0)))),
    }


def with_citability(df: DataFrame, c: dict[str, Column]) -> DataFrame:
    """``df`` with the criteria and now: their weighted mean, null without answer and facts;
    fix_first: the criterion with the greatest weighted gap, if it matters; after: with that one
    mended. In steps, so that no expression is written out over and over in the generated code."""
    w = W.CITABILITY
    known = F.col("answer").isNotNull() | F.col("facts").isNotNull()
    gaps = F.array(*[F.when(F.col(k).isNotNull(), F.struct((F.lit(v) * (1 - F.col(k))).alias("gap"), F.lit(-i).alias("ord"), F.lit(k).alias("name"))) for i, (k, v) in enumerate(w.items())])
    out = df.withColumns({k: c[k].cast("double") for k in w}).withColumn("__gap", F.array_max(gaps))
    out = out.withColumns({"now": F.when(known, weighted([(F.col(k), v) for k, v in w.items()])), "fix_first": F.when(known & (F.col("__gap.gap") > 0.04), F.col("__gap.name"))})
    mended = {k: F.when((F.col("fix_first") == k) & (F.col(k) < W.FIX_TARGET), W.FIX_TARGET).otherwise(F.col(k)) for k in w}
    out = out.withColumns({f"__{k}": v for k, v in mended.items()}).withColumn("__after", weighted([(F.col(f"__{k}"), v) for k, v in w.items()]))
    after = F.when(known, F.greatest(F.col("now"), F.when(F.col("fix_first").isNull(), F.col("now")).otherwise(F.col("__after"))))
    return out.withColumn("after", after).drop("__gap", "__after", *[f"__{k}" for k in w])


def score10(index: Column) -> Column:
    return F.floor(index * 100 + 0.5) / F.lit(10.0)


def competitor_overall(s: dict[str, Column]) -> Column:
    """Null if less than half of the weight is known."""
    known = reduce(lambda a, b: a + b, [F.when(s[k].isNotNull(), w).otherwise(0.0) for k, w in W.COMPETITOR.items()])
    return F.when(known >= 0.5, weighted([(s[k], w) for k, w in W.COMPETITOR.items()]))


def competitor_verdict(readable: Column, page_type: Column, relevance: Column, overall: Column, ours: Column) -> Column:
    copyable = page_type.isin("service_page", "company_homepage", "comparison_listicle", "ecommerce_product", "blog_article", "platform_or_tool")
    return (
        F.when(~readable, "unreadable").when(~copyable, "not_copyable").when(relevance < W.STEAL_MIN_RELEVANCE, "off_topic").when(overall.isNull(), "unknown")
        .when(overall < W.STEAL_AT, "weak").when(overall <= ours + 0.03, "no_better").otherwise("steal")
    )


def techniques(theirs: dict[str, Column], ours: dict[str, Column]) -> Column:
    """At most six things that their page has and ours lacks."""
    rules = [
        ((theirs["faq"] >= 0.8) & (F.coalesce(ours["faq"], F.lit(0.0)) < 0.5), "faq"), ((theirs["compare"] >= 0.7) & (F.coalesce(ours["compare"], F.lit(0.0)) < 0.5), "table"),
        (theirs["words"] >= F.coalesce(ours["words"], F.lit(0)) * 1.5, "longer"), ((theirs["fresh"] >= 0.8) & (F.coalesce(ours["fresh"], F.lit(0.0)) < 0.5), "fresher"),
        ((theirs["author"] >= 0.6) & (F.coalesce(ours["author"], F.lit(0.0)) < 0.4), "author"), ((theirs["sources"] >= 0.6) & (F.coalesce(ours["sources"], F.lit(0.0)) < 0.4), "sources"),
    ]
    return F.slice(F.array_compact(F.array(*[F.when(r, F.lit(n)) for r, n in rules])), 1, 6)


def select_competitor_pages(results: DataFrame, own: str, tracked: list[str], social: list[str], budget: int, top: int = 5) -> DataFrame:
    """(phrase, url, domain, position, place): of each phrase the first ``top`` (tracked before
    the rest), one of each phrase in turn, each address once."""
    kept = results.where((F.col("domain") != own) & ~F.col("domain").isin(social))
    order = Window.partitionBy("phrase").orderBy(F.when(F.col("domain").isin(tracked), 0).otherwise(1), "position", "url")
    rounds = kept.withColumn("round", F.row_number().over(order)).where(F.col("round") <= top)
    one = rounds.groupBy("url").agg(F.min_by(F.struct("phrase", "domain", "position"), F.struct("round", "phrase")).alias("r"), F.min(F.struct("round", "phrase")).alias("o"))
    best = one.orderBy("o.round", "o.phrase").limit(budget)
    return best.select("r.phrase", "url", "r.domain", "r.position", F.row_number().over(Window.orderBy("o.round", "o.phrase")).alias("place"))


def rank_factor(rank: Column) -> Column:
    return F.when(rank.isNull(), 0.6).when(rank <= 3, 0.4).when(rank <= 10, 1.0).when(rank <= 30, 0.9).otherwise(0.7)


def _verdict(*rules: tuple[Column, str, float | Column], keep: float = 0.8) -> Column:
    """The first rule that holds, as (issue, confidence); else keep."""
    out = None
    for rule, issue, confidence in rules:
        made = F.struct(F.lit(issue).alias("issue"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).cast("double").alias("confidence"))
        out = F.when(rule, made) if out is None else out.when(rule, made)
    return out.otherwise(F.struct(F.lit("keep").alias("issue"), F.lit(keep).cast("double").alias("confidence")))


def element_verdicts(pages: DataFrame) -> DataFrame:
    """(url, element, issue, confidence, impact): the rules of the eleven elements, applied where
    they apply. Judged shares (nullable): title_clear, meta_inviting, h1_matches, intro_direct,
    outline, faq_useful. Counts of equal values on the site: title_same, meta_same, h1_same."""
    c = F.col
    n, d = F.length("title"), F.length("description")
    judged = lambda p: F.abs(p * 2 - 1)
    useful = F.filter("schema_types", lambda t: ~t.isin(GENERIC_SCHEMA))
    rules = {
        "title": _verdict((c("title").isNull(), "missing", 1.0), (n > 62, "long", 0.9), (n < 25, "short", 0.8), (c("title_same") > 1, "duplicate", 0.95), (c("title_coverage") < 0.6, "off_phrase", 0.85), (c("title_clear") < 0.5, "unclear", judged(c("title_clear")))),
        "meta": _verdict((c("description").isNull(), "missing", 1.0), (d > 160, "long", 0.8), (d < 70, "short", 0.75), (c("meta_same") > 1, "duplicate", 0.9), (c("meta_inviting") < 0.5, "dull", judged(c("meta_inviting")))),
        "h1": _verdict((c("h1") == 0, "missing", 1.0), (c("h1") > 1, "several", 0.85), (c("h1_same") > 1, "duplicate", 0.85), (c("h1_matches") < 0.5, "mismatch", judged(c("h1_matches")))),
        "intro": F.when((F.length("intro") < 60) | c("intro_direct").isNotNull(), _verdict((F.length("intro") < 60, "short", 0.9), (c("intro_direct") < 0.5, "indirect", judged(c("intro_direct"))))),
        "h2": F.when(c("words") >= 300, _verdict((c("h2") == 0, "none", 0.95), ((c("words") >= 900) & (c("h2") < 3), "few", 0.8), (c("outline") < 0.5, "weak", F.least(F.lit(1.0), judged(c("outline")) * 0.6 + 0.4)))),
        "faq": F.when(
            c("faq_schema") | c("faq_section") | ((c("words") >= 250) & c("page_type").isin("service_page", "blog_article", "ecommerce_product", "company_homepage")),
            _verdict((c("faq_schema") & (c("faq_useful") < 0.5), "useless", judged(c("faq_useful"))), (~c("faq_schema") & c("faq_section"), "no_schema", 0.9), (~c("faq_schema"), "wanted", 0.75)),
        ),
        "schema": F.when((F.size("schema_types") > 0) | (c("words") >= 120) | (c("page_type") == "company_homepage"), _verdict((F.size("schema_types") == 0, "none", 0.85), (F.size(useful) == 0, "generic", 0.7))),
        "canonical": _verdict((c("noindex"), "noindex", 1.0), (c("canonical").isNull(), "none", 0.7), (~c("canonical_self"), "foreign", 0.7), keep=0.9),
        "url": _verdict((c("url_problem").isNotNull(), "problem", 0.7)),
        "links": F.when(c("words") >= 150, _verdict((c("links_in") < 5, "few", 0.7))),
        "images": F.when(c("images") > 0, _verdict((c("images_alt") / F.nullif(c("images").cast("double"), F.lit(0.0)) < 0.8, "no_alt", 0.85))),
    }
    rows = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(e).alias("element"), v.getField("issue").alias("issue"), v.getField("confidence").alias("confidence"), F.lit(W.ELEMENT_WEIGHT[e]).alias("weight"))) for e, v in rules.items()]))
    each = pages.select("url", "page_type", "rank", F.explode(rows).alias("v")).select("url", "page_type", "rank", "v.*")
    importance = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in W.PAGE_IMPORTANCE.items() for x in kv]), F.col("page_type")), F.lit(0.35))
    impact = F.least(F.lit(1.0), importance * F.col("weight") * rank_factor(F.col("rank")) * (F.col("confidence") * 0.5 + 0.5))
    return each.select("url", "element", "issue", r3(F.col("confidence")).alias("confidence"), F.when(F.col("issue") == "keep", 0.0).otherwise(r3(impact)).alias("impact"))


def pages_worth_rewriting(verdicts: DataFrame, k: int = 24) -> DataFrame:
    changed = verdicts.where(F.col("element").isin("title", "meta", "h1", "intro") & (F.col("issue") != "keep"))
    milli = F.floor(F.col("impact") * 1000 + 0.5).cast("long")
    return changed.groupBy("url").agg(F.sum(milli).alias("impact_milli"), F.count(F.lit(1)).alias("changes")).orderBy(F.desc("impact_milli"), "url").limit(k)
