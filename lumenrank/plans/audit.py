"""Queries of the site audit: null-aware means, criteria, citability, verdicts, signals, pages to copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import urls as U
from ..functions import text as T
from ..operators import audit, html, phrases, signals
from ..sources.shared import written
from ..sources.tables import read_table
from .pages import NOW
from .serp import OWN, RESULTS_SQL, TRACKED, serp_results
from .text import _M  # noqa: F401

SOCIAL = ["Supplier#000000005"]


def _share(m: int, add: int = 0, mod: int = 101):
    return ((F.col("id") * m + add) % mod) / F.lit(float(mod - 1))


def _known(m: int, every: int, add: int = 0):
    return F.when(F.col("id") % every != 0, _share(m, add))


_S = lambda m, add=0: f"((id * {m} + {add}) % 101) / 100.0::DOUBLE"
_K = lambda m, every, add=0: f"CASE WHEN id % {every} <> 0 THEN {_S(m, add)} END"
_WEIGHTED = lambda parts: "floor((" + " + ".join(f"coalesce(least(1, greatest(0, {v}))::DOUBLE * {w}::DOUBLE, 0)" for v, w in parts) + ") / nullif(" + " + ".join(f"CASE WHEN ({v}) IS NOT NULL THEN {w}::DOUBLE ELSE 0 END" for v, w in parts) + ", 0) * 1000 + 0.5) / 1000.0::DOUBLE"  # noqa: E731, E501


def weighted_null_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as judgments: a missing part leaves the mean, it does not lower it."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    rows = docs.join(read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic"), "id", "left")
    score = N.weighted([(F.col("quality"), 0.5), (1 - F.col("toxic"), 0.3), (F.when(F.col("n_chars") > 200, F.col("n_chars") / F.lit(2000.0)), 0.2)])
    return rows.select("id", score.alias("score"), N.confidence_level(score).alias("level"))


CRITERIA = [("answer", 7, 5), ("facts", 11, 3), ("sources", 13, 1000003), ("author", 17, 1000003), ("faq", 19, 1000003), ("fresh", 23, 4), ("compare", 29, 1000003), ("links", 31, 1000003)]


def citability_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    made = audit.with_citability(rows, {k: _known(m, e) for k, m, e in CRITERIA})
    return made.select("id", "now", "fix_first", "after", audit.score10(F.col("now")).alias("score10"))


def page_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Criteria of every crawled page from its facts and from judged shares."""
    pages = html.page_facts(read_table(spark, sf_dir, "pages"), NOW, limits=html.Limits(None, None, None, None, None)).select(F.col("page_id").alias("id"), "url", "facts.*")
    at = lambda c: F.to_timestamp(F.col(c))
    months = audit.age_months(at("modified_at"), at("published_at"), F.col("latest_year"), F.lit(NOW.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp"))
    f = {c: F.col(c) for c in ("external_domains", "registration", "about_link", "faq_schema", "faq_section", "tables", "lists", "links_in", "words")}
    f |= {"answer": _known(7, 5), "facts": _known(11, 3), "cites": _known(13, 2), "identity": _known(17, 2), "author_hint": F.col("author"), "address": F.col("address"), "faq_questions": F.size("faq_questions"), "question_heads": F.lit(0), "age_months": months}
    made = audit.with_citability(pages, audit.criteria(f))
    return made.select("id", *[k for k, _, _ in CRITERIA], "now", "fix_first")


def _judged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    # parsed once: what follows reads the facts several times
    pages = written(html.page_facts(read_table(spark, sf_dir, "pages"), NOW, limits=html.Limits(None, None, None, None, None)).select(F.col("page_id").alias("id"), "url", U.host(F.col("url")).alias("site"), "facts.*"), "page-facts")
    heads = F.transform(F.filter("headings", lambda h: h["level"] == 1), lambda h: h["text"])
    pages = pages.withColumn("h1_texts", heads)
    for value, name in ((F.col("title"), "title_same"), (F.col("description"), "meta_same"), (F.get("h1_texts", F.lit(0)), "h1_same")):
        pages = phrases.duplicate_values(pages, "site", value, name)
    types = F.array(*[F.lit(t) for t in ("service_page", "blog_article", "company_homepage", "other")])
    pages = pages.withColumn("phrase", T.phrase_of(F.get("h1_texts", F.lit(0)), F.col("title")))
    flags = T.keyword_flags(F.coalesce("phrase", F.lit("")), F.col("title"), F.col("h1_texts"), F.col("description"), F.col("intro"), F.col("url"))
    return pages.select(
        "*", F.get(types, (F.col("id") % 4).cast("int")).alias("page_type"), F.when(F.col("id") % 3 == 0, (F.col("id") % 40).cast("int")).alias("rank"), *[v.alias(k) for k, v in flags.items()],
        _known(5, 2).alias("title_clear"), _known(7, 2).alias("meta_inviting"), _known(9, 3).alias("h1_matches"), _known(11, 3).alias("intro_direct"), _known(13, 2).alias("outline"), _known(15, 2).alias("faq_useful"), U.problem(F.col("url")).alias("url_problem"),
    )


def element_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.element_verdicts(_judged_pages(spark, sf_dir))


def pages_worth_rewriting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.pages_worth_rewriting(element_verdicts(spark, sf_dir))


def page_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strengths and weaknesses of every crawled page beside the others of its site."""
    pages = _judged_pages(spark, sf_dir)
    peers = pages.groupBy("site").agg(F.median("words").alias("peer_words"), F.count(F.lit(1)).alias("peer_pages"), F.avg((F.col("faq_schema") | F.col("faq_section")).cast("double")).alias("peer_faq"))
    rows = pages.join(peers, "site")
    m = {c: F.col(c) for c in rows.columns} | {"price_texts": F.col("prices"), "cta_texts": F.col("cta"), "ttfb_ms": F.col("id") * 37 % 2000, "fetch_status": F.col("status")}
    j = {"depth": _known(7, 5), "depth_confidence": _share(43), "targets": _known(11, 3), "generic": _known(13, 2), "prices": _known(17, 2), "portfolio": _known(19, 3), "reviews": _known(23, 4), "cta": _known(29, 3), "identity": _known(31, 3), "page_type": F.col("page_type"), "type_confidence": _share(37)}
    made = signals.page_signals(m, j, {"words": F.col("peer_words"), "pages": F.col("peer_pages"), "faq_share": F.col("peer_faq"), "intent": F.lit("transactional")}, NOW.year)
    named = lambda kind: F.array_join(F.transform(signals.listed(F.col("s"), kind), lambda s: s["id"]), ",")
    return rows.withColumn("s", made).select("id", named("strength").alias("strengths"), named("weakness").alias("weaknesses"))


def page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _judged_pages(spark, sf_dir)
    m = {c: F.col(c) for c in ("title", "description", "images", "images_alt", "title_coverage", "h1", "h2", "canonical_self", "viewport", "https", "noindex", "words")}
    m |= {"in_h1": F.col("in_h1"), "in_url": F.col("in_url"), "in_meta": F.col("in_meta"), "has_schema": F.size("schema_types") > 0}
    optimization = audit.optimization_score(m)
    j = {"words": F.col("words"), "depth": _known(7, 5), "need": _known(11, 3), "generic": _known(13, 2), "portfolio": _known(17, 2), "reviews": _known(19, 3), "identity": _known(23, 4), "contact": F.col("phones") + F.col("emails") > 0, "cta": _known(29, 3), "prices": _known(31, 3), "form": F.col("form")}
    made = audit.composite_scores(j, optimization)
    return pages.select("id", optimization.alias("optimization"), *[v.alias(k) for k, v in made.items()])


def freshness_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age and freshness of orders, as of a fixed day."""
    now = F.lit("1999-01-01 00:00:00").cast("timestamp")
    rows = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_timestamp(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("at"))
    months = audit.age_months(F.col("at"), F.lit(None).cast("timestamp"), F.lit(None).cast("int"), now)
    return rows.select("id", months.alias("months"), audit.freshness(months).alias("fresh"))


def competitor_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = serp_results(spark, sf_dir).select(F.col("keyword").alias("phrase"), F.concat(F.lit("https://"), "domain", F.lit("/"), (F.col("key") % 3).cast("string")).alias("url"), "domain", "position")
    return audit.select_competitor_pages(rows, OWN, TRACKED, SOCIAL, 20)


def competitor_page_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    types = F.array(*[F.lit(t) for t in ("service_page", "blog_article", "forum_or_social", "other")])
    overall = audit.competitor_overall({"answer": _known(7, 5), "depth": _known(11, 3), "proof": _known(13, 2), "schema": _share(17), "fresh": _known(19, 4)})
    verdict = audit.competitor_verdict(F.col("id") % 9 != 0, F.get(types, (F.col("id") % 4).cast("int")), _share(23), overall, _share(29))
    theirs = {"faq": _share(31), "compare": _share(37), "words": F.col("id") * 13 % 2000, "fresh": _share(41), "author": _share(43), "sources": _share(47)}
    ours = {"faq": _known(53, 3), "compare": _known(59, 3), "words": F.col("id") * 7 % 1500, "fresh": _known(61, 3), "author": _known(67, 3), "sources": _known(71, 3)}
    return rows.select("id", overall.alias("overall"), verdict.alias("verdict"), F.array_join(audit.techniques(theirs, ours), ",").alias("techniques"))


def peer_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of each score over the pages of each source, what is unknown left out."""
    rows = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    return rows.groupBy("source").agg(F.median(_known(7, 5)).alias("content"), F.median(_known(11, 3)).alias("trust"), F.count(_known(13, 2)).alias("judged"))


QUERIES = {
    f.__name__: f
    for f in (
        weighted_null_mean, citability_index, page_criteria, element_verdicts, pages_worth_rewriting, page_signals, page_scores, freshness_ramp, competitor_pages, competitor_page_verdicts, peer_medians,
    )
}

_W = {"answer": 0.22, "facts": 0.17, "sources": 0.14, "author": 0.12, "faq": 0.1, "fresh": 0.1, "compare": 0.08, "links": 0.07}
_C = {k: _K(m, e) for k, m, e in CRITERIA}

ORACLE_SQL = {
    "weighted_null_mean": f"""WITH r AS (SELECT doc_id AS id, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)),
s AS (SELECT id, {_WEIGHTED([('quality', 0.5), ('1 - toxic', 0.3), ('CASE WHEN n_chars > 200 THEN n_chars / 2000.0::DOUBLE END', 0.2)])} AS score FROM r)
SELECT id, score, CASE WHEN score >= 0.6 THEN 'high' WHEN score >= 0.3 THEN 'medium' ELSE 'low' END AS level FROM s""",
    "citability_index": f"""WITH c AS (SELECT id, {', '.join(f'{v} AS {k}' for k, v in _C.items())} FROM (SELECT doc_id AS id FROM documents)),
g AS (SELECT *, list_max([x FOR x IN [{', '.join(f"CASE WHEN {k} IS NOT NULL THEN {{'gap': {w}::DOUBLE * (1 - {k}), 'ord': {-i}, 'name': '{k}'}} END" for i, (k, w) in enumerate(_W.items()))}] IF x IS NOT NULL]) AS best,
  answer IS NOT NULL OR facts IS NOT NULL AS known FROM c),
f AS (SELECT *, CASE WHEN known AND best.gap > 0.04 THEN best.name END AS fix_first, CASE WHEN known THEN {_WEIGHTED(list(_W.items()))} END AS now FROM g),
a AS (SELECT *, {_WEIGHTED([(f"CASE WHEN fix_first = '{k}' AND {k} < 0.8 THEN 0.8::DOUBLE ELSE {k} END", w) for k, w in _W.items()])} AS lifted FROM f)
SELECT id, now, fix_first, CASE WHEN known THEN greatest(now, CASE WHEN fix_first IS NULL THEN now ELSE lifted END) END AS after, floor(now * 100 + 0.5) / 10.0::DOUBLE AS score10 FROM a""",
    "freshness_ramp": """WITH m AS (SELECT o_orderkey AS id, greatest(0, floor((epoch(TIMESTAMP '1999-01-01') - epoch(date_trunc('day', o_orderdate))) / (86400 * 30.44::DOUBLE) * 10 + 0.5) / 10)::DOUBLE AS months FROM orders)
SELECT id, months, CASE WHEN months <= 6 THEN 1.0::DOUBLE WHEN months >= 24 THEN 0.1::DOUBLE ELSE floor((1 - (months - 6) / 18 * 0.9::DOUBLE) * 1000 + 0.5) / 1000.0::DOUBLE END AS fresh FROM m""",
    "competitor_pages": f"""WITH {RESULTS_SQL}, r AS (SELECT keyword AS phrase, 'https://' || domain || '/' || (key % 3) AS url, domain, position FROM serp WHERE domain NOT IN ('{OWN}', '{SOCIAL[0]}')),
t AS (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY (domain NOT IN ('{TRACKED[0]}', '{TRACKED[1]}'))::INT, position, url) AS round FROM r QUALIFY round <= 5),
o AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY round, phrase) AS n FROM t QUALIFY n = 1)
SELECT phrase, url, domain, position, row_number() OVER (ORDER BY round, phrase)::INT AS place FROM o QUALIFY place <= 20""",
    "competitor_page_verdicts": f"""WITH d AS (SELECT doc_id AS id FROM documents),
c AS (SELECT id, {_K(7, 5)} AS answer, {_K(11, 3)} AS depth, {_K(13, 2)} AS proof, {_S(17)} AS schema_, {_K(19, 4)} AS fresh, {_S(23)} AS relevance, {_S(29)} AS ours, ['service_page', 'blog_article', 'forum_or_social', 'other'][id % 4 + 1] AS type FROM d),
o AS (SELECT *, CASE WHEN CASE WHEN answer IS NOT NULL THEN 0.28::DOUBLE ELSE 0 END + CASE WHEN depth IS NOT NULL THEN 0.28::DOUBLE ELSE 0 END + CASE WHEN proof IS NOT NULL THEN 0.2::DOUBLE ELSE 0 END + 0.12::DOUBLE + CASE WHEN fresh IS NOT NULL THEN 0.12::DOUBLE ELSE 0 END >= 0.5
  THEN {_WEIGHTED([('answer', 0.28), ('depth', 0.28), ('proof', 0.2), ('schema_', 0.12), ('fresh', 0.12)])} END AS overall FROM c)
SELECT id, overall, CASE WHEN id % 9 = 0 THEN 'unreadable' WHEN type NOT IN ('service_page', 'blog_article') THEN 'not_copyable' WHEN relevance < 0.45 THEN 'off_topic' WHEN overall IS NULL THEN 'unknown' WHEN overall < 0.58 THEN 'weak' WHEN overall <= ours + 0.03::DOUBLE THEN 'no_better' ELSE 'steal' END AS verdict,
array_to_string([x FOR x IN [CASE WHEN {_S(31)} >= 0.8 AND coalesce({_K(53, 3)}, 0) < 0.5 THEN 'faq' END, CASE WHEN {_S(37)} >= 0.7 AND coalesce({_K(59, 3)}, 0) < 0.5 THEN 'table' END, CASE WHEN id * 13 % 2000 >= (id * 7 % 1500) * 1.5::DOUBLE THEN 'longer' END,
  CASE WHEN {_S(41)} >= 0.8 AND coalesce({_K(61, 3)}, 0) < 0.5 THEN 'fresher' END, CASE WHEN {_S(43)} >= 0.6 AND coalesce({_K(67, 3)}, 0) < 0.4 THEN 'author' END, CASE WHEN {_S(47)} >= 0.6 AND coalesce({_K(71, 3)}, 0) < 0.4 THEN 'sources' END] IF x IS NOT NULL], ',') AS techniques FROM o""",
    "peer_medians": f"SELECT source, median({_K(7, 5)}) AS content, median({_K(11, 3)}) AS trust, count({_K(13, 2)}) AS judged FROM (SELECT doc_id AS id, source FROM documents) GROUP BY source",
}
