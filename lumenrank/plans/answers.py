"""Queries over assistants' answers: conversations give questions and answers, engines by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..functions import urls as U
from ..operators import answers as A
from ..operators import buyers, recovery
from ..sources.tables import read_table

ENGINES = ["alpha", "beta", "gamma"]
BRANDS = [("ing-studio.example", True), ("tion.example", False), ("that.example", False), ("with.example", False)]
PRICES = [("alpha", "a-1", 2.0, 10.0), ("alpha", "a-1-mini", 0.5, 2.0), ("beta", "b", 1.0, 5.0)]
FEES = {"alpha": 0.01, "beta": 0.01, "gamma": 0.014}


def _engine(x):
    return F.get(F.array(*[F.lit(e) for e in ENGINES]), (x % 3).cast("int"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "conv_id", _engine(F.col("conv_id")).alias("engine"), "text")


def _citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """None to four domains an answer, by formula."""
    places = F.filter(F.sequence(F.lit(0), F.lit(3)), lambda o: o < (F.col("answer_id") * 3 + F.col("conv_id")) % 5)
    each = _answers(spark, sf_dir).select("answer_id", "engine", F.explode(places).alias("ordinal"))
    domain = F.concat(F.lit("site"), ((F.col("answer_id") * 7 + F.col("ordinal") * F.col("ordinal") * 3) % 9).cast("string"))
    return each.select("answer_id", "engine", "ordinal", domain.alias("domain"), (domain == "site4").alias("own"))


def wilson_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source").join(read_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    out = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").cast("long").alias("k")).withColumn("w", N.wilson(F.col("k"), F.col("n")))
    return out.select("source", "n", "k", "w.share", "w.low", "w.high")


def brand_mentions_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = spark.createDataFrame(BRANDS, "domain string, own boolean")
    return A.mentions(_answers(spark, sf_dir), brands).select("answer_id", "domain", F.col("at").cast("long").alias("first_at"))


def answer_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = spark.createDataFrame(BRANDS, "domain string, own boolean")
    rows = _answers(spark, sf_dir)
    return A.analyse(rows, _citations(spark, sf_dir), A.mentions(rows, brands))


def engine_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _answers(spark, sf_dir)
    placed = A.analyse(rows, _citations(spark, sf_dir), spark.createDataFrame([], "answer_id long, domain string, own boolean, at int"))
    records = rows.join(placed, "answer_id").select("engine", "answer_id", (F.col("conv_id") % 11 == 0).alias("failed"), "status", F.length("text").cast("long").alias("tokens"))
    return A.summarize_engines(records)


def overall_citation_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the engines' rates."""
    return engine_summary(spark, sf_dir).agg(N.r3(F.avg("rate")).alias("rate"), F.sum("asked").alias("asked"))


def top_cited_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_cited(_citations(spark, sf_dir), 5)


def price_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = F.get(F.array(*[F.lit(x) for x in ("a-1", "models/a-1-mini-2026", "A-1-large", "b", "bb", "a-10")]), (F.col("conv_id") % 6).cast("int"))
    usage = _answers(spark, sf_dir).select("answer_id", "engine", models.alias("model"), (F.length("text") * 3).alias("input_tokens"), F.length("text").alias("output_tokens"), (F.col("conv_id") % 3).alias("searches"))
    return A.estimate_cost(usage, spark.createDataFrame(PRICES, "engine string, known string, input double, output double"), FEES).select("answer_id", "engine", "model", "usd")


def cross_engine_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.col("conv_id") * 1000 + F.col("turn")
    questions = read_table(spark, sf_dir, "conversations").where("role = 'user'").select(asked.alias("question_id"), asked.alias("ordinal"))
    return A.plan_calls(questions, ENGINES, 50)


def answer_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("answer_id")
    p = lambda m: (k * m % 101) / F.lit(100.0)
    return _answers(spark, sf_dir).select("answer_id", A.sentiment(p(7), p(11), p(13), p(17)).alias("sentiment"))


def source_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    domains = ("en.wikipedia.org", "reddit.com", "shop.example", "news.example", "data.gov.bg", "x.edu", "blog.example")
    types = ("blog_article", "service_page", "news_or_media", "comparison_listicle", "other", "forum_or_social")
    k = F.col("doc_id")
    pick = lambda xs, c: F.get(F.array(*[F.lit(x) for x in xs]), (c % len(xs)).cast("int"))
    kind = U.source_kind(pick(domains, k), pick(types, k), (k % 10) / F.lit(10.0), (k % 7) / F.lit(7.0))
    return read_table(spark, sf_dir, "documents").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("pages"))


def _skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("answer_id")
    known = lambda m, every: F.when(k % every != 0, (k * m % 101) / F.lit(100.0))
    c = {"words": k * 13 % 1500, "winner_words": F.when(k % 4 != 0, k * 17 % 2500), "angle": known(7, 5), "answer": known(11, 3), "facts": known(19, 4), "author": known(23, 6), "age": k % 30, "fresh": known(29, 3), "sources": known(31, 2), "has_page": k % 5 != 0}
    return _answers(spark, sf_dir).select("answer_id", "conv_id", "engine", A.skip_reasons(c).alias("reasons"))


def skip_reasons_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _skips(spark, sf_dir).select("answer_id", F.array_join("reasons", ",").alias("reasons"))


def plan_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans over lost answers by page or cluster of questions, with the commonest first reason."""
    n, create = F.col("conv_id") % 15, F.col("conv_id") % 15 < 5
    rows = _skips(spark, sf_dir).select(
        F.col("answer_id").alias("ordinal"), "engine", F.concat(F.lit("q"), F.col("conv_id").cast("string")).alias("text"), F.when(~create, F.concat(F.lit("page"), n.cast("string"))).alias("our_url"),
        F.when(create, "create").otherwise("rewrite").alias("action"), F.array(F.get("reasons", F.lit(0))).alias("reasons"), F.lit(None).cast("string").alias("winner_domain"), n.alias("cluster"),
    )
    clusters = rows.where("action = 'create'").select("text", "cluster").distinct()
    titles = rows.select("our_url", F.col("our_url").alias("title")).where("our_url is not null").distinct()
    plans = recovery.build_plans(rows.drop("cluster"), clusters, titles, ENGINES)
    return plans.select("key", F.col("kind").alias("action"), "lost", F.col("n_questions").alias("questions"), F.size("engines").cast("long").alias("engines"), F.get("reasons", F.lit(0)).alias("first_reason"), "priority", "place")


def question_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which answers of a conversation share the most terms with each of its questions; the first
    lines of an answer stand for a page's head."""
    rows = read_table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    questions = rows.where("role = 'user'").select(F.col("conv_id").alias("scope"), F.col("id").alias("question_id"), T.keyword_terms(F.col("text")).alias("terms")).where(F.size("terms") > 0)
    pages = rows.where("role = 'assistant'").select(F.col("conv_id").alias("scope"), F.col("id").cast("string").alias("url"), F.array_distinct(T.terms(F.substring_index("text", "\n", 1))).alias("head"), F.array_distinct(T.terms(F.col("text"))).alias("intro"))
    return A.coverage_pairs(questions, pages)


def next_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda xs, c: F.get(F.array(*[F.lit(x) for x in xs]), (c % len(xs)).cast("int"))
    step = buyers.next_step(pick(["discover", "compare", "price", "trust", "howto", "local"], k), pick(["no_page", "weak", "answered"], F.floor(k / 6)), (k % 10) / F.lit(10.0), (k % 7) / F.lit(7.0))
    return read_table(spark, sf_dir, "orders").groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("questions"))


QUERIES = {
    f.__name__: f
    for f in (
        wilson_by_group, brand_mentions_first, answer_analysis, engine_summary, overall_citation_rate, top_cited_domains, price_longest_prefix, cross_engine_budget, answer_sentiment, source_kinds, skip_reasons_rank, plan_groups,
        question_coverage, next_steps,
    )
}

from .text import _KW, _M  # noqa: E402

_A = "a AS (SELECT conv_id * 1000 + turn AS answer_id, conv_id, ['alpha', 'beta', 'gamma'][conv_id % 3 + 1] AS engine, text FROM conversations WHERE role = 'assistant')"
_CITE = "c AS (SELECT answer_id, engine, o AS ordinal, 'site' || ((answer_id * 7 + o * o * 3) % 9) AS domain, (answer_id * 7 + o * o * 3) % 9 = 4 AS own FROM (SELECT *, unnest(range(0, (answer_id * 3 + conv_id) % 5)) AS o FROM a))"
_WILSON = lambda k, n: f"coalesce(floor({k} / {n}::DOUBLE * 1000 + 0.5) / 1000.0::DOUBLE, 0) AS S, coalesce(floor(greatest(0, ({k} / {n}::DOUBLE + 3.8416::DOUBLE / ({n} * 2)) / (1 + 3.8416::DOUBLE / {n}) - 1.96::DOUBLE * sqrt({k} / {n}::DOUBLE * (1 - {k} / {n}::DOUBLE) / {n} + 3.8416::DOUBLE / ({n}::DOUBLE * {n} * 4)) / (1 + 3.8416::DOUBLE / {n})) * 1000 + 0.5) / 1000.0::DOUBLE, 0) AS low, coalesce(floor(least(1, ({k} / {n}::DOUBLE + 3.8416::DOUBLE / ({n} * 2)) / (1 + 3.8416::DOUBLE / {n}) + 1.96::DOUBLE * sqrt({k} / {n}::DOUBLE * (1 - {k} / {n}::DOUBLE) / {n} + 3.8416::DOUBLE / ({n}::DOUBLE * {n} * 4)) / (1 + 3.8416::DOUBLE / {n})) * 1000 + 0.5) / 1000.0::DOUBLE, 0) AS high"  # noqa: E731, E501
_P = lambda m: f"(answer_id * {m} % 101) / 100.0::DOUBLE"
_PK = lambda m, e: f"CASE WHEN answer_id % {e} <> 0 THEN {_P(m)} END"
_SUMMARY = f"""{_A}, {_CITE}, d AS (SELECT DISTINCT answer_id FROM c WHERE own),
r AS (SELECT a.*, d.answer_id IS NOT NULL AS cited, conv_id % 11 = 0 AS failed FROM a LEFT JOIN d USING (answer_id)),
s AS (SELECT engine, count(*) AS asked, count(*) FILTER (NOT failed) AS answered, count(*) FILTER (failed) AS failed, count(*) FILTER (NOT failed AND cited) AS citing, count(*) FILTER (NOT failed AND NOT cited) AS skipping, sum(length(text))::BIGINT AS tokens FROM r GROUP BY engine),
t AS (SELECT *, {_WILSON('citing', 'answered').replace(' AS S', ' AS rate')} FROM s)"""
_SKIP = f"""{_A}, v AS (SELECT *, answer_id * 13 % 1500 AS words, CASE WHEN answer_id % 4 <> 0 THEN answer_id * 17 % 2500 END AS winner, {_PK(7, 5)} AS angle, {_PK(11, 3)} AS answer, {_PK(19, 4)} AS facts, {_PK(23, 6)} AS author, answer_id % 30 AS age, {_PK(29, 3)} AS fresh, {_PK(31, 2)} AS sources FROM a),
m AS (SELECT *, list_sort([x FOR x IN [CASE WHEN angle < 0.4 THEN (-(1.2::DOUBLE - angle), 0, 'wrong_angle') END, CASE WHEN answer < 0.45 THEN (-(1 - answer), 1, 'no_answer') END,
  CASE WHEN words < 350 OR words < winner * 0.6::DOUBLE THEN (-coalesce(1 - words / nullif(winner, 0)::DOUBLE, 0.7::DOUBLE), 2, 'too_thin') END, CASE WHEN facts < 0.4 THEN (-(1 - facts), 3, 'no_facts') END,
  CASE WHEN author < 0.35 THEN (-(1 - author), 4, 'no_author') END, CASE WHEN age >= 18 OR fresh < 0.4 THEN (-coalesce(1 - fresh, 0.6::DOUBLE), 5, 'stale') END] IF x IS NOT NULL]) AS made,
  list_min([x FOR x IN [CASE WHEN answer IS NOT NULL THEN (answer, 0, 'no_answer') END, CASE WHEN facts IS NOT NULL THEN (facts, 1, 'no_facts') END, CASE WHEN sources IS NOT NULL THEN (sources, 2, 'weak_trust') END] IF x IS NOT NULL]) AS weakest FROM v),
k AS (SELECT answer_id, conv_id, engine, CASE WHEN answer_id % 5 = 0 THEN ['no_page'] WHEN len(made) > 0 THEN [x[3] FOR x IN made[1:4]] ELSE [coalesce(weakest[3], 'too_thin')] END AS reasons FROM m)"""

ORACLE_SQL = {
    "wilson_by_group": f"WITH g AS (SELECT source, count(*) AS n, sum(quality)::BIGINT AS k FROM documents JOIN labels USING (doc_id) GROUP BY source) SELECT source, n, k, {_WILSON('k', 'n').replace(' AS S', ' AS share')} FROM g",
    "engine_summary": f"WITH {_SUMMARY} SELECT * FROM t",
    "overall_citation_rate": f"WITH {_SUMMARY} SELECT floor(avg(rate) * 1000 + 0.5) / 1000.0::DOUBLE AS rate, sum(asked)::BIGINT AS asked FROM t",
    "top_cited_domains": f"WITH {_A}, {_CITE}, g AS (SELECT engine, domain, count(DISTINCT answer_id) AS answers FROM c GROUP BY ALL) SELECT engine, domain, answers, row_number() OVER (PARTITION BY engine ORDER BY answers DESC, domain)::INT AS place FROM g QUALIFY place <= 5",
    "price_longest_prefix": f"""WITH {_A}, u AS (SELECT *, ['a-1', 'models/a-1-mini-2026', 'A-1-large', 'b', 'bb', 'a-10'][conv_id % 6 + 1] AS model FROM a),
p AS (SELECT * FROM (VALUES ('alpha', 'a-1', 2.0::DOUBLE, 10.0::DOUBLE), ('alpha', 'a-1-mini', 0.5, 2.0), ('beta', 'b', 1.0, 5.0)) t(e, known, i, o)),
j AS (SELECT answer_id, engine, model, conv_id, length(text) AS n, arg_max(i, length(known)) AS i, arg_max(o, length(known)) AS o FROM u LEFT JOIN p ON e = engine AND (regexp_replace(lower(model), '^models/', '') = known OR starts_with(regexp_replace(lower(model), '^models/', ''), known || '-')) GROUP BY ALL)
SELECT answer_id, engine, model, floor(((n * 3 * i + n * o) / 1000000 + conv_id % 3 * CASE WHEN engine = 'gamma' THEN 0.014::DOUBLE ELSE 0.01::DOUBLE END) * 10000 + 0.5) / 10000 AS usd FROM j""",
    "cross_engine_budget": "WITH q AS (SELECT conv_id * 1000 + turn AS question_id, conv_id * 1000 + turn AS ordinal FROM conversations WHERE role = 'user' ORDER BY 2 LIMIT 16) SELECT engine, question_id, ordinal FROM q, (SELECT unnest(['alpha', 'beta', 'gamma']) AS engine)",
    "answer_sentiment": f"WITH {_A} SELECT answer_id, CASE WHEN {_P(17)} <= 0.6 THEN floor(({_P(7)} + {_P(11)} * 0.5::DOUBLE) / nullif({_P(7)} + {_P(11)} + {_P(13)}, 0) * 1000 + 0.5) / 1000.0::DOUBLE END AS sentiment FROM a",
    "skip_reasons_rank": f"WITH {_SKIP} SELECT answer_id, array_to_string(reasons, ',') AS reasons FROM k",
    "plan_groups": f"""WITH {_SKIP}, s AS (SELECT CASE WHEN conv_id % 15 < 5 THEN 'new:' ELSE 'page:page' END || (conv_id % 15) AS key, CASE WHEN conv_id % 15 < 5 THEN 'create' ELSE 'rewrite' END AS action, conv_id AS question_id, engine, reasons[1] AS reason FROM k),
f AS (SELECT key, arg_min(reason, (-n, reason)) AS first_reason FROM (SELECT key, reason, count(*) AS n FROM s GROUP BY ALL) GROUP BY key),
p AS (SELECT key, action, count(*) AS lost, count(DISTINCT question_id) AS questions, count(DISTINCT engine) AS engines, (SELECT count(*) FROM s) AS t FROM s GROUP BY key, action)
SELECT key, action, lost, questions, engines, first_reason, floor((lost * 2000 + t) / (2 * t)) / 1000.0::DOUBLE AS priority, row_number() OVER (ORDER BY lost DESC, questions DESC, key)::INT AS place FROM p JOIN f USING (key) QUALIFY place <= 12""",
    "question_coverage": _M + f"""WITH q AS (SELECT conv_id AS scope, conv_id * 1000 + turn AS question_id, {_KW.format('text')} AS terms FROM conversations WHERE role = 'user'),
p AS (SELECT conv_id AS scope, (conv_id * 1000 + turn)::VARCHAR AS url, unnest(list_distinct(lr_terms(string_split(text, chr(10))[1]))) AS term, 7 AS part FROM conversations WHERE role = 'assistant'
  UNION ALL SELECT conv_id, (conv_id * 1000 + turn)::VARCHAR, unnest(list_distinct(lr_terms(text))), 3 FROM conversations WHERE role = 'assistant'),
w AS (SELECT scope, url, term, sum(part)::BIGINT AS part FROM p GROUP BY ALL), e AS (SELECT scope, question_id, len(terms) AS n, unnest(terms) AS term FROM q),
m AS (SELECT question_id, url, floor((sum(part) * 200 + n) / (2 * n)) / 1000.0::DOUBLE AS overlap FROM e JOIN w USING (scope, term) GROUP BY question_id, url, n)
SELECT question_id, url, overlap, row_number() OVER (PARTITION BY question_id ORDER BY overlap DESC, url)::INT AS place FROM m WHERE overlap >= 0.12 QUALIFY place <= 3""",
    "next_steps": """WITH k AS (SELECT ['discover', 'compare', 'price', 'trust', 'howto', 'local'][o_orderkey % 6 + 1] AS s, ['no_page', 'weak', 'answered'][(o_orderkey // 6) % 3 + 1] AS v, (o_orderkey % 10) / 10.0::DOUBLE AS a, (o_orderkey % 7) / 7.0::DOUBLE AS f FROM orders)
SELECT CASE WHEN v = 'answered' THEN 'none' WHEN v = 'no_page' THEN CASE s WHEN 'compare' THEN 'write_versus' WHEN 'local' THEN 'add_local' ELSE 'write_guide' END WHEN a < 0.4 THEN CASE s WHEN 'compare' THEN 'write_versus' ELSE 'write_guide' END
  WHEN f < 0.5 THEN 'answer_at_top' ELSE CASE s WHEN 'trust' THEN 'add_proof' WHEN 'price' THEN 'add_prices' WHEN 'local' THEN 'add_local' ELSE 'answer_at_top' END END AS step, count(*) AS questions FROM k GROUP BY step""",
}

_NAMED = """b(domain, own, pattern) AS (VALUES ('ing-studio.example', true, 'ing-studio\\.example'), ('ing-studio.example', true, 'ing-studio'), ('ing-studio.example', true, 'ing studio'), ('ing-studio.example', true, 'ingstudio'),
  ('tion.example', false, 'tion\\.example'), ('tion.example', false, 'tion'), ('that.example', false, 'that\\.example'), ('that.example', false, 'that'), ('with.example', false, 'with\\.example'), ('with.example', false, 'with')),
h AS (SELECT answer_id, domain, own, regexp_extract(lower(text), '(?s)^((?:.*?[^\\p{L}\\p{N}])??)' || pattern || '(?:[^\\p{L}\\p{N}]|$)', 1) AS head FROM a, b WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])' || pattern || '([^\\p{L}\\p{N}]|$)')),
f AS (SELECT answer_id, domain, own, min(length(head) + 1)::BIGINT AS pos FROM h GROUP BY ALL)"""
_KINDS = """CASE WHEN d IN ('en.wikipedia.org', 'data.gov.bg') THEN 'authority' WHEN d = 'reddit.com' OR t = 'forum_or_social' THEN 'community' WHEN t = 'news_or_media' THEN 'media' WHEN t = 'comparison_listicle' THEN 'compare'
  WHEN t = 'blog_article' THEN CASE WHEN s >= 0.7 AND w >= 0.6 THEN 'authority' ELSE 'guide' END WHEN t = 'service_page' THEN 'brand' ELSE 'other' END"""
ORACLE_SQL |= {
    "brand_mentions_first": f"WITH {_A}, {_NAMED} SELECT answer_id, domain, pos AS first_at FROM f",
    "answer_analysis": f"""WITH {_A}, {_CITE}, {_NAMED}, o AS (SELECT answer_id, domain, own, min(ordinal) AS first FROM c GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY first) AS place, count(*) OVER (PARTITION BY answer_id) AS n FROM o), w AS (SELECT answer_id, min(place) AS place, max(n) AS n FROM p WHERE own GROUP BY answer_id),
m AS (SELECT answer_id, pos FROM f WHERE own), r AS (SELECT f.answer_id, count(*) FILTER (f.pos < m.pos) AS before, count(*) AS others FROM f JOIN m USING (answer_id) WHERE NOT own GROUP BY f.answer_id)
SELECT answer_id, CASE WHEN place IS NOT NULL THEN 'cited' WHEN pos IS NOT NULL THEN 'named' ELSE 'missing' END AS status, CASE WHEN place IS NOT NULL THEN place WHEN pos IS NOT NULL THEN coalesce(before, 0) + 1 END::BIGINT AS position,
CASE WHEN place IS NOT NULL THEN floor((2000 + n) / (2 * n)) / 1000.0::DOUBLE WHEN pos IS NOT NULL THEN floor((2000 + coalesce(others, 0) + 1) / (2 * (coalesce(others, 0) + 1))) / 1000.0::DOUBLE ELSE 0 END AS share
FROM a LEFT JOIN w USING (answer_id) LEFT JOIN m USING (answer_id) LEFT JOIN r USING (answer_id)""",
    "source_kinds": f"""WITH k AS (SELECT ['en.wikipedia.org', 'reddit.com', 'shop.example', 'news.example', 'data.gov.bg', 'x.edu', 'blog.example'][doc_id % 7 + 1] AS d, ['blog_article', 'service_page', 'news_or_media', 'comparison_listicle', 'other', 'forum_or_social'][doc_id % 6 + 1] AS t,
(doc_id % 10) / 10.0::DOUBLE AS s, (doc_id % 7) / 7.0::DOUBLE AS w FROM documents) SELECT {_KINDS} AS kind, count(*) AS pages FROM k GROUP BY 1""",
}
