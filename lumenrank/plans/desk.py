"""Queries of the report's panels, of judging, of signals by rule, and of deterministic draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draws
from ..functions import numbers as N
from ..functions import text as T
from ..functions import weights as W
from ..operators import audit, desk, judge, signals
from ..sources.tables import read_table
from .answers import _A, _CITE, ENGINES, _citations
from .audit import _K, _S, _WEIGHTED, _known, _share
from .buyers import _RECORDS, _records
from .pages import _URL_SQL, _pages
from .text import _KW, _M, _docs

def _id():
    return F.col("id")


def _ids(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), *more)


def _pick(values: list[str], c):
    return F.get(F.array(*[F.lit(v) for v in values]), (c % len(values)).cast("int"))


# ---- pages by rule, from formulas over all documents: the operators that real pages go through too
TYPES = ["service_page", "blog_article", "company_homepage", "other", "ecommerce_product"]


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = lambda m: _id() % m != 0
    some = lambda e, c: F.when(_id() % e != 0, c)
    return _ids(spark, sf_dir).select(
        "id", F.concat(F.lit("https://p.example/"), _id().cast("string")).alias("url"), some(19, F.repeat(F.lit("t"), (_id() * 7 % 90).cast("int"))).alias("title"), some(6, F.repeat(F.lit("d"), (_id() * 11 % 230).cast("int"))).alias("description"),
        F.when(_id() % 31 != 0, (_id() * 13 % 3100).cast("int")).alias("words"), (_id() % 3).cast("int").alias("h1"), (_id() % 9).cast("int").alias("h2"), (_id() % 12).cast("int").alias("images"), F.least(_id() % 12, _id() * 5 % 13).cast("int").alias("images_alt"),
        F.slice(F.array(F.lit("WebPage"), F.lit("Service"), F.lit("FAQPage")), F.lit(1), (_id() % 4).cast("int")).alias("schema_types"), (_id() % 5 == 0).alias("faq_schema"), (_id() % 3 == 0).alias("faq_section"), flag(7).alias("viewport"), flag(8).alias("https"),
        (_id() % 17 == 0).alias("noindex"), some(4, (2020 + _id() % 8).cast("int")).alias("latest_year"), some(9, (_id() * 37 % 2000).cast("int")).alias("ttfb_ms"), F.when(_id() % 13 != 0, "ok").otherwise("timeout").alias("fetch_status"),
        _share(3).alias("title_coverage"), (_id() % 2 == 0).alias("in_h1"), (_id() % 4 == 0).alias("starts_title"), F.slice(F.array(F.lit("10 EUR"), F.lit("20 EUR")), F.lit(1), (_id() % 3).cast("int")).alias("price_texts"), F.slice(F.array(F.lit("Call"), F.lit("Order"), F.lit("Ask")), F.lit(1), (_id() % 4).cast("int")).alias("cta_texts"),
        some(5, F.repeat(F.lit("i"), (_id() * 3 % 120).cast("int"))).alias("intro"), _pick(TYPES, _id()).alias("page_type"), F.when(_id() % 3 == 0, (_id() % 40).cast("int")).alias("rank"), F.when(_id() % 6 != 0, F.when(_id() % 4 == 0, "https://x.example/").otherwise("self")).alias("canonical"), (_id() % 4 != 0).alias("canonical_self"),
        (_id() % 11).cast("int").alias("links_in"), _pick(["parameters", "capitals"], _id()).alias("p"), (1 + (_id() % 10 == 0).cast("long")).alias("title_same"), (1 + (_id() % 14 == 0).cast("long")).alias("meta_same"), (1 + (_id() % 16 == 0).cast("long")).alias("h1_same"),
    ).withColumn("url_problem", F.when(_id() % 5 == 1, F.col("p"))).drop("p")


_RE = lambda c, m, n, e: f"CASE WHEN id % {e} <> 0 THEN repeat('{c}', (id * {m} % {n})::INT) END"
_FACTS = f"""g AS (SELECT doc_id AS id FROM documents), facts AS (SELECT id, 'https://p.example/' || id AS url, {_RE('t', 7, 90, 19)} AS title, {_RE('d', 11, 230, 6)} AS description, CASE WHEN id % 31 <> 0 THEN id * 13 % 3100 END AS words, id % 3 AS h1, id % 9 AS h2, id % 12 AS images, least(id % 12, id * 5 % 13) AS images_alt,
(['WebPage', 'Service', 'FAQPage'])[1 : id % 4] AS schema_types, id % 5 = 0 AS faq_schema, id % 3 = 0 AS faq_section, id % 7 <> 0 AS viewport, id % 8 <> 0 AS https, id % 17 = 0 AS noindex, CASE WHEN id % 4 <> 0 THEN 2020 + id % 8 END AS latest_year, CASE WHEN id % 9 <> 0 THEN id * 37 % 2000 END AS ttfb_ms, id % 13 <> 0 AS fetched,
{_S(3)} AS title_coverage, id % 2 = 0 AS in_h1, id % 4 = 0 AS starts_title, (['10 EUR', '20 EUR'])[1 : id % 3] AS price_texts, (['Call', 'Order', 'Ask'])[1 : id % 4] AS cta_texts, {_RE('i', 3, 120, 5)} AS intro, ['service_page', 'blog_article', 'company_homepage', 'other', 'ecommerce_product'][id % 5 + 1] AS page_type,
CASE WHEN id % 3 = 0 THEN id % 40 END AS rank, id % 6 <> 0 AS has_canonical, id % 4 <> 0 AS canonical_self, id % 11 AS links_in, 1 + (id % 10 = 0)::INT AS title_same, 1 + (id % 14 = 0)::INT AS meta_same, 1 + (id % 16 = 0)::INT AS h1_same, CASE WHEN id % 5 = 1 THEN 'x' END AS url_problem FROM g)"""
_JUDGED = {"depth": (7, 5), "depth_confidence": (43, 1_000_003), "targets": (11, 6), "generic": (13, 4), "prices": (17, 5), "portfolio": (19, 3), "reviews": (23, 7), "cta": (29, 8), "identity": (31, 9), "type_confidence": (37, 1_000_003)}
_JUDGED_SQL = ", ".join(f"{_K(m, e)} AS {k}" for k, (m, e) in _JUDGED.items())


def signal_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every strength and weakness of every page with evidence, source and confidence, in order."""
    rows = _facts(spark, sf_dir).withColumns({k: _known(m, e) for k, (m, e) in _JUDGED.items()})
    m = {c: F.col(c) for c in rows.columns}
    peers = {"words": F.lit(900.0), "pages": F.lit(5), "faq_share": F.lit(0.5), "intent": F.lit("transactional")}
    made = rows.select("id", F.posexplode(signals.page_signals(m, m, peers, 2026)).alias("at", "s"))
    return made.select("id", "at", "s.*").toDF("id", "nth", "signal", "kind", "evidence", "source", "confidence")


_YES = {"title_clear": (5, 2), "meta_inviting": (7, 2), "h1_matches": (9, 3), "intro_direct": (11, 3), "outline": (13, 2), "faq_useful": (15, 2)}


def element_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _facts(spark, sf_dir).withColumns({k: _known(m, e) for k, (m, e) in _YES.items()})
    return audit.element_verdicts(rows)


def rewriting_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.pages_worth_rewriting(element_rules(spark, sf_dir))


def score_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optimisation and composite scores."""
    rows = _facts(spark, sf_dir)
    m = {c: F.col(c) for c in rows.columns} | {"in_url": _id() % 3 == 0, "in_meta": _id() % 5 == 0, "has_schema": F.size("schema_types") > 0}
    optimization = audit.optimization_score(m)
    j = {"words": F.col("words"), "depth": _known(7, 5), "need": _known(11, 3), "generic": _known(13, 2), "portfolio": _known(17, 2), "reviews": _known(19, 3), "identity": _known(23, 4), "contact": _id() % 2 == 0, "cta": _known(29, 3), "prices": _known(31, 3), "form": _id() % 3 == 0}
    made = audit.composite_scores(j, optimization, F.lit(800.0))
    return rows.select("id", optimization.alias("optimization"), *[v.alias(k) for k, v in made.items()])


def criteria_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight criteria and schema richness."""
    rows = _facts(spark, sf_dir)
    f = {"answer": _known(7, 5), "facts": _known(11, 3), "external_domains": _id() % 7, "cites": _known(13, 2), "identity": _known(17, 2), "author_hint": _id() % 2 == 0, "registration": _id() % 3 == 0, "address": _id() % 5 == 0, "about_link": _id() % 7 == 0}
    f |= {"faq_schema": F.col("faq_schema"), "faq_section": F.col("faq_section"), "faq_questions": _id() % 4, "question_heads": _id() % 3, "age_months": F.when(_id() % 6 != 0, _id() % 30), "tables": _id() % 2, "lists": _id() % 5, "links_in": F.col("links_in"), "words": F.coalesce("words", F.lit(0))}
    c = audit.criteria(f)
    return rows.select("id", *[v.cast("double").alias(k) for k, v in c.items()], audit.schema_richness(F.col("schema_types")).alias("richness"))


def element_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = element_rules(spark, sf_dir).withColumn("id", F.regexp_extract("url", r"(\d+)$", 1).cast("long"))
    return desk.element_order(rows, 40).select("id", "element", "issue", "impact", "place")


def expected_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _facts(spark, sf_dir).select(desk.has_expected_schema(F.col("page_type"), F.col("schema_types")).alias("expected"), "page_type")
    return rows.groupBy("page_type", "expected").agg(F.count(F.lit(1)).alias("pages"))


def keyword_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each page has its keyword: the first two words of its first paragraph."""
    h = F.col("html")
    first = F.regexp_extract(h, r"<p>([^<]*)", 1)
    rows = _pages(spark, sf_dir).select("page_id", "url", F.regexp_extract(h, r"<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract_all(h, F.lit(r"<h1>([^<]*)</h1>"), F.lit(1)).alias("h1"), first.alias("body"), F.array_join(F.slice(F.split(first, " "), 1, 2), " ").alias("keyword"))
    flags = T.keyword_flags(F.col("keyword"), F.col("title"), F.col("h1"), F.lit(None).cast("string"), F.col("body"), F.col("url"))
    return rows.select("page_id", *[v.alias(k) if v is not flags["title_coverage"] else N.r3(v).alias(k) for k, v in flags.items()])


def page_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    return _pages(spark, sf_dir).select("page_id", T.phrase_of(F.regexp_extract(h, r"<h1>([^<]*)</h1>", 1), F.regexp_extract(h, r"<title>([^<]*)</title>", 1)).alias("phrase"))


def intro_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first paragraphs of documents, their first line taken for a heading."""
    return _docs(spark, sf_dir).select("doc", F.md5(T.intro_prose(F.col("text"), F.array(F.substring_index("text", "\n", 1)))).alias("intro"))


# ---- judging
def question_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.question_dim(spark).groupBy("set", "kind").agg(F.count(F.lit(1)).alias("questions"), F.max("levels").alias("levels"))


def applicable_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages each element question is asked of."""
    rows = _facts(spark, sf_dir)
    m = {c: F.col(c) for c in ("title", "description", "h1", "words", "h2")} | {"intro": F.coalesce("intro", F.lit("")), "faq": _id() % 4}
    return rows.select(F.explode(judge.applicable(m)).alias("question_id")).groupBy("question_id").agg(F.count(F.lit(1)).alias("pages"))


def judge_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for the documents' languages and sources: equal states are asked once, failures stay null."""
    rows = _ids(spark, sf_dir, "lang", "source")
    sent = judge.requests(rows, "id", F.struct("lang", "source"), F.array(F.lit("a"), F.lit("b")))
    n = F.conv(F.substring("request", 1, 4), 16, 10).cast("int")
    came = sent.select("request").distinct().select("request", F.when(n % 3 != 0, (n % 100).cast("string")).alias("answer"), F.when(n % 3 == 0, "timeout").alias("error"))
    return judge.asked(sent, came).groupBy("request").agg(F.count(F.lit(1)).alias("pages"), F.max("answer").alias("answer"), F.bool_or("failed").alias("failed"))


KINDS = ["shop", "guide", "news", "other"]


def debiased_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A choice asked both ways round by a judge that leans to the first option, for each document; every seventh twin does not come."""
    wired = judge.wired(_ids(spark, sf_dir).select("id", F.col("id").cast("string").alias("state")), {"page_type": KINDS}, ["page_type"])
    own = {o: F.col("id") * (3 * i + 7) % 11 / F.lit(8.0) for i, o in enumerate(KINDS)}
    said = F.create_map(*[x for o in KINDS for x in (F.lit(o), own[o] + F.when(F.get("options", F.lit(0)) == o, 0.25).otherwise(0.0))])
    came = wired.select("id", "wire_id", F.when(~((F.col("id") % 7 == 0) & F.endswith("wire_id", F.lit(judge.REVERSED))), said).alias("probs"))
    return judge.unbiased(wired, came).drop("question_id")


def judged_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve judgments a page in one row, and whether they are whole."""
    asked = [F.struct(F.lit(q).alias("question_id"), F.lit(i).alias("ordinal")) for i, (s, q, _, _) in enumerate(judge.QUESTIONS) if s in judge.PAGE_SETS]
    tall = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("entity_id"), F.explode(F.array(*asked)).alias("q")).select("entity_id", "q.*")
    n = F.col("entity_id") + F.col("ordinal")
    answers = tall.where((n % 7 != 0) & (F.col("entity_id") % 6 != 0) | (F.col("entity_id") % 4 == 0)).select("entity_id", "question_id", (n * 7 % 101 / F.lit(100.0)).alias("p"))
    every = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("entity_id"))
    wide = judge.judged_pages(answers)
    return every.join(wide, "entity_id", "left").select("entity_id", N.r3(F.col("topic_depth")).alias("depth"), N.r3(F.col("clear_cta")).alias("cta"), F.coalesce("status", F.lit("none")).alias("status"))


def screened_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part").select(F.col("p_name").alias("keyword"), "p_partkey")
    k = F.col("p_partkey")
    one = part.groupBy("keyword").agg(F.min("p_partkey").alias("p_partkey"))
    answers = one.select("keyword", F.when(k % 4 != 0, k * 7 % 101 / F.lit(100.0)).alias("relevance"), _pick(["transactional", "informational"], k).alias("intent"))
    return judge.judged_keywords(one.select("keyword"), answers).groupBy("intent").agg(F.count(F.lit(1)).alias("keywords"), F.max("relevance").alias("best"))


def judge_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.cost(read_table(spark, sf_dir, "conversations").select(F.length("text").cast("long").alias("input_tokens")), 0.25)


def offline_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that stand in for the judge, over facts."""
    rows = _facts(spark, sf_dir)
    m = {c: F.col(c) for c in ("title", "description", "words", "h2", "intro")} | {"h1_text": F.when(_id() % 3 != 0, F.lit("garden tools")), "prices": _id() % 3, "ctas": _id() % 4, "contact": _id() % 2 == 0, "proof": _id() % 3, "identity": _id() % 5 == 0, "lists": _id() % 4, "tables": _id() % 2, "external_domains": _id() % 4}
    out = judge.offline(m, F.lit("garden tools"))
    return rows.select("id", *[v.alias(k) for k, v in out.items() if k in ("topic_depth", "states_prices", "shows_identity", "title_clear", "h1_matches", "outline_logical", "specific_facts", "cites_sources", "generic_content")])


# ---- panels
def worst_citability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ids(spark, sf_dir).select(_id().cast("string").alias("url"), N.weighted([(_known(7, 5), 0.5), (_known(11, 3), 0.5)]).alias("now"))
    return desk.citability_rows(rows, 50).select("url", "now", "place")


def answer_filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk.answer_counts(_records(spark, sf_dir))


def question_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("question_id"), F.md5("text").alias("text"))
    blank = rows.withColumn("text", F.when(F.col("question_id") % 3 != 0, F.col("text")).otherwise(" "))
    return desk.question_index(blank, rows.where("question_id % 2 = 0"))


def winner_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _citations(spark, sf_dir).where("not own").groupBy("domain").agg(F.count_distinct("answer_id").alias("cited_in"), (F.max("ordinal") * 1.5).alias("score10"))
    return desk.sorted_winners(rows, 5)


def visible_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _citations(spark, sf_dir).groupBy("engine", "domain", "own").agg(F.count_distinct("answer_id").alias("n"))
    return desk.visible_domains(rows, 3)


def page_type_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "part").select(F.col("p_brand").alias("keyword"), _pick(W.PAGE_TYPES, F.col("p_partkey") * F.col("p_size")).alias("page_type"))
    return desk.type_shares(rows, 3)


def report_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("keyword"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("top_domain"))
    return desk.search_reports(rows, "AND#1").select("p_partkey")


def running_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "orders").select(_pick(["queued", "running", "done", "error"], F.col("o_orderkey")).alias("status"), F.col("o_orderpriority").alias("kind"))
    return desk.running_jobs(rows)


def usage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    rows = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("service"), (k % 900).alias("tokens"), F.when((F.col("event_type") != "error") | (k % 5 != 0), k % 70).alias("cost_micro"), (k % 9 == 0).alias("failed"))
    return desk.usage_rows(rows)


def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    rows = read_table(spark, sf_dir, "documents").select(F.col("source").alias("site"), F.when(k % 29 == 0, "blocked_robots").when(k % 31 == 0, "timeout").otherwise("ok").alias("fetch"), F.when(k % 23 == 0, "partial").otherwise("complete").alias("judged"))
    return desk.run_status(rows).select("site", "pages", "status", F.array_join("warnings", "; ").alias("warnings"))


def output_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents").join(read_table(spark, sf_dir, "labels"), "doc_id", "left")
    return desk.violations(rows, {"judged": F.col("quality").isNotNull(), "long_enough": F.col("n_chars") >= 100, "one_sign": F.col("quality") + F.col("toxic") <= 1, "named": F.col("source") != ""})


def engine_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("answer_id")
    records = _records(spark, sf_dir).withColumn("searches", k % 4).withColumn("cost_micro", F.when((F.col("engine") != "gamma") | (k % 3 != 0), k % 50))
    return desk.engine_rows(records, _citations(spark, sf_dir), "site4", 4).withColumn("cited_instead", F.array_join("cited_instead", ","))


def ai_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk.ai_share(_records(spark, sf_dir), _citations(spark, sf_dir))


def answer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk.answer_record(_records(spark, sf_dir)).select("answer_id", "status", F.md5("excerpt").alias("excerpt"))


def competitor_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ids(spark, sf_dir).select("id", F.when(_id() % 5 == 0, "steal").otherwise("weak").alias("verdict"), _known(7, 3).alias("overall"))
    return desk.competitor_order(rows, 30)


def criteria_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk.weighted_criteria(spark)


def brief_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("pages"), F.sum("p_size").alias("target"))
    c = {"target": F.col("target"), "pages": F.col("pages"), "type": F.lit("service_page"), "least": F.floor(F.col("target") / 2), "most": F.col("target") * 2, "starts": F.col("pages") / F.lit(10.0), "terms": F.col("pages") % 3, "questions": F.col("pages") % 2, "faq_share": F.lit(0.4)}
    return rows.select("p_brand", desk.brief_summary(c).alias("summary"), F.array_join(desk.brief_checklist(c), "; ").alias("checklist"))


def plan_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("place"), F.concat("p_name", F.lit(" *https://x.example*")).alias("title"), F.array("p_type", F.concat(F.lit("[a]"), "p_brand")).alias("steps"))
    return desk.plan_markdown(rows)


def run_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ceilings of what runs of these sizes would ask for."""
    rows = [("run", *x, k, v) for x in ((10, 15, 16), (20, 45, 40)) for k, v in desk.estimate_run(*x).items()]
    rows += [("audit", p, q, e, k, v) for p, q, e in ((100, 60, 3), (5, 0, 0)) for k, v in desk.estimate_audit(p, q, e, 150).items()]
    return spark.createDataFrame(rows, "kind string, a int, b int, c int, what string, n int")


def seeded_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of each name, the first number it draws, and options in the order it gives."""
    rows = read_table(spark, sf_dir, "part").select("p_partkey", draws.fnv1a(F.col("p_name")).alias("hash"))
    order = draws.seeded_shuffle(F.array(*[F.lit(x) for x in "abcdef"]), F.col("hash"))
    return rows.select("p_partkey", "hash", draws.draw(F.col("hash")).alias("drawn"), F.array_join(F.sort_array(order), "").alias("options"))


def figures_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rate = k % 101 / F.lit(100.0)
    return read_table(spark, sf_dir, "part").select(
        "p_partkey", T.percent(rate).alias("share"), T.interval(rate, F.greatest(rate - (k % 7) / F.lit(100.0), F.lit(0.0)), F.least(rate + (k % 5) / F.lit(100.0), F.lit(1.0))).alias("span"), T.latency((k * 37 % 3000).cast("double")).alias("latency"), T.money((k % 40) / F.lit(32.0)).alias("usd")
    )


def page_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an answer that ask something, each once."""
    rows = read_table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return rows.select("conv_id", "turn", F.size(T.faq_questions(F.split("text", "\n"))).alias("questions"))


QUERIES = {
    f.__name__: f
    for f in (
        signal_rules, element_rules, rewriting_rules, score_rules, criteria_rules, element_order, expected_schema, keyword_flags, page_phrases, intro_texts, question_catalogue, debiased_choices, applicable_questions, judge_requests, judged_slices, screened_keywords, judge_cost,
        offline_judge, worst_citability, answer_filter_counts, question_texts, winner_order, visible_domains, page_type_shares, report_search, running_jobs, usage_rows, run_status, output_checks, engine_rows, ai_shares, answer_records, competitor_order,
        criteria_weights, brief_notes, plan_markdown, run_estimates, seeded_draws, figures_as_text, page_questions,
    )
}


_LVL = lambda c: f"CASE WHEN {c} >= 0.6 THEN 'high' WHEN {c} >= 0.3 THEN 'medium' ELSE 'low' END"
_SURE = lambda p: _LVL(f"abs({p} * 2 - 1)")
_PCT = lambda p: f"floor({p} * 100 + 0.5)::BIGINT || '%'"
_SAID = lambda p: f"'judged ' || {_PCT(p)}"
_USEFUL = "[t FOR t IN schema_types IF lower(t) <> 'webpage']"
_N, _D = "coalesce(length(title), 0)", "length(description)"
_DEPTH = f"'depth ' || {_PCT('depth')} || ', confidence ' || {_PCT('depth_confidence')}"
_READ = "words IS NOT NULL"
_SIGNALS = [
    ("deep_content", "depth >= 0.7 AND depth_confidence >= 0.3", _DEPTH, "'judged'", _LVL("depth_confidence")),
    ("pricing", "prices >= 0.7", f"coalesce(price_texts[1], {_SAID('prices')})", "CASE WHEN len(price_texts) > 0 THEN 'measured' ELSE 'judged' END", f"CASE WHEN len(price_texts) > 0 THEN 'high' ELSE {_SURE('prices')} END"),
    ("portfolio", "portfolio >= 0.7", _SAID("portfolio"), "'judged'", _SURE("portfolio")), ("reviews", "reviews >= 0.7", _SAID("reviews"), "'judged'", _SURE("reviews")),
    ("cta", "cta >= 0.7", f"CASE WHEN len(cta_texts) > 0 THEN array_to_string(cta_texts[1:2], ', ') ELSE {_SAID('cta')} END", "CASE WHEN len(cta_texts) > 0 THEN 'measured' ELSE 'judged' END", _SURE("cta")),
    ("identity", "identity >= 0.7", _SAID("identity"), "'judged'", _SURE("identity")), ("long_content", "words >= 1125", "words || ' words'", "'measured'", "'high'"),
    ("dedicated_to_query", "targets >= 0.75", _SAID("targets"), "'judged'", _SURE("targets")), ("keyword_in_title_h1", f"{_READ} AND title_coverage >= 0.999 AND in_h1", "CASE WHEN starts_title THEN 'title starts with it' ELSE 'in both' END", "'measured'", "'high'"),
    ("faq", f"{_READ} AND (faq_schema OR faq_section)", "CASE WHEN faq_schema THEN 'with markup' ELSE 'section' END", "'measured'", "'high'"), ("schema_markup", f"{_READ} AND len({_USEFUL}) > 0", f"array_to_string({_USEFUL}, ', ')", "'measured'", "'high'"),
    ("fresh", f"{_READ} AND latest_year >= 2025", "'mentions ' || latest_year", "'measured'", "'medium'"), ("image_alt", f"{_READ} AND images >= 5 AND images_alt / images::DOUBLE >= 0.8", "images_alt || ' of ' || images", "'measured'", "'high'"),
    ("fast_response", "fetched AND ttfb_ms > 0 AND ttfb_ms < 400", "ttfb_ms || ' ms'", "'measured'", "'low'"), ("thin_content", "words < 300", "words || ' words'", "'measured'", "'high'"),
    ("shallow_topic", "depth <= 0.4 AND depth_confidence >= 0.3", _DEPTH, "'judged'", _LVL("depth_confidence")), ("generic_text", "generic >= 0.7", _SAID("generic"), "'judged'", _SURE("generic")), ("not_dedicated", "targets <= 0.3", _SAID("targets"), "'judged'", _SURE("targets")),
    ("off_intent_type", "type_confidence >= 0.3 AND page_type IN ('blog_article', 'other')", "page_type || ' for transactional'", "'judged'", _LVL("type_confidence")), ("keyword_missing_title", f"{_READ} AND title_coverage < 0.5", "coalesce(title, '—')", "'measured'", "'high'"),
    *[(f"no_{n}", f"{c} <= 0.25", _SAID(c), "'judged'", _SURE(c)) for n, c in (("pricing", "prices"), ("cta", "cta"), ("portfolio", "portfolio"), ("reviews", "reviews"), ("identity", "identity"))],
    ("below_median_length", "words >= 300 AND words < 450", "words || ' words, median 900'", "'measured'", "'high'"), ("no_h1", f"{_READ} AND h1 = 0", "'none'", "'measured'", "'high'"), ("multiple_h1", f"{_READ} AND h1 > 1", "h1 || ' H1'", "'measured'", "'high'"),
    ("no_meta", f"{_READ} AND coalesce({_D}, 0) = 0", "'none'", "'measured'", "'high'"), ("meta_length", f"{_READ} AND {_D} > 0 AND ({_D} < 50 OR {_D} > 200)", f"{_D} || ' characters'", "'measured'", "'high'"),
    ("title_length", f"{_READ} AND ({_N} > 70 OR {_N} BETWEEN 1 AND 19)", f"{_N} || ' characters'", "'measured'", "'high'"), ("no_schema", f"{_READ} AND len({_USEFUL}) = 0", "'none'", "'measured'", "'high'"),
    ("no_faq", f"{_READ} AND NOT (faq_schema OR faq_section)", "'50% of peers have one'", "'measured'", "'medium'"), ("no_viewport", f"{_READ} AND NOT viewport", "'none'", "'measured'", "'high'"), ("no_https", f"{_READ} AND NOT https", "'none'", "'measured'", "'high'"),
    ("noindex", f"{_READ} AND noindex", "'set'", "'measured'", "'high'"), ("image_alt_missing", f"{_READ} AND images >= 5 AND images_alt / images::DOUBLE < 0.4", "images_alt || ' of ' || images", "'measured'", "'high'"),
    ("outdated", f"{_READ} AND latest_year <= 2023", "'last mentions ' || latest_year", "'measured'", "'medium'"), ("slow_response", "fetched AND ttfb_ms > 1500", "ttfb_ms || ' ms'", "'measured'", "'low'"),
]
_SIGNAL_SQL = f"""WITH {_FACTS}, j AS (SELECT *, {_JUDGED_SQL} FROM facts),
s AS (SELECT id, unnest([x FOR x IN [{', '.join(f"CASE WHEN {rule} THEN {{'o': {i}, 'signal': '{n}', 'kind': '{'strength' if i < 14 else 'weakness'}', 'evidence': {e}, 'source': {src}, 'confidence': {c}}} END" for i, (n, rule, e, src, c) in enumerate(_SIGNALS))}] IF x IS NOT NULL]) AS x FROM j)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY x.o) - 1)::INT AS nth, x.signal AS signal, x.kind AS kind, x.evidence AS evidence, x.source AS source, x.confidence AS confidence FROM s"""

_ABS = lambda c: f"abs({c} * 2 - 1)"
_RULES = {
    "title": ("true", [("title IS NULL", "missing", "1.0"), ("length(title) > 62", "long", "0.9"), ("length(title) < 25", "short", "0.8"), ("title_same > 1", "duplicate", "0.95"), ("title_coverage < 0.6", "off_phrase", "0.85"), ("title_clear < 0.5", "unclear", _ABS("title_clear"))]),
    "meta": ("true", [("description IS NULL", "missing", "1.0"), (f"{_D} > 160", "long", "0.8"), (f"{_D} < 70", "short", "0.75"), ("meta_same > 1", "duplicate", "0.9"), ("meta_inviting < 0.5", "dull", _ABS("meta_inviting"))]),
    "h1": ("true", [("h1 = 0", "missing", "1.0"), ("h1 > 1", "several", "0.85"), ("h1_same > 1", "duplicate", "0.85"), ("h1_matches < 0.5", "mismatch", _ABS("h1_matches"))]),
    "intro": ("length(intro) < 60 OR intro_direct IS NOT NULL", [("length(intro) < 60", "short", "0.9"), ("intro_direct < 0.5", "indirect", _ABS("intro_direct"))]),
    "h2": ("words >= 300", [("h2 = 0", "none", "0.95"), ("words >= 900 AND h2 < 3", "few", "0.8"), ("outline < 0.5", "weak", f"least(1, {_ABS('outline')} * 0.6 + 0.4)")]),
    "faq": ("faq_schema OR faq_section OR words >= 250 AND page_type IN ('service_page', 'blog_article', 'ecommerce_product', 'company_homepage')", [("faq_schema AND faq_useful < 0.5", "useless", _ABS("faq_useful")), ("NOT faq_schema AND faq_section", "no_schema", "0.9"), ("NOT faq_schema", "wanted", "0.75")]),
    "schema": ("len(schema_types) > 0 OR words >= 120 OR page_type = 'company_homepage'", [("len(schema_types) = 0", "none", "0.85"), ("len([t FOR t IN schema_types IF t <> 'WebPage']) = 0", "generic", "0.7")]),
    "canonical": ("true", [("noindex", "noindex", "1.0"), ("NOT has_canonical", "none", "0.7"), ("NOT canonical_self", "foreign", "0.7")]), "url": ("true", [("url_problem IS NOT NULL", "problem", "0.7")]),
    "links": ("words >= 150", [("links_in < 5", "few", "0.7")]), "images": ("images > 0", [("images_alt / images::DOUBLE < 0.8", "no_alt", "0.85")]),
}
_CASE = lambda rules, keep: "CASE " + " ".join(f"WHEN {r} THEN {{'issue': '{i}', 'confidence': ({c})::DOUBLE}}" for r, i, c in rules) + f" ELSE {{'issue': 'keep', 'confidence': {keep}::DOUBLE}} END"
_VERDICTS = f"""{_FACTS}, j AS (SELECT *, {', '.join(f'{_K(m, e)} AS {k}' for k, (m, e) in _YES.items())} FROM facts),
v AS ({' UNION ALL '.join(f"SELECT id, url, page_type, rank, '{e}' AS element, {W.ELEMENT_WEIGHT[e]}::DOUBLE AS weight, {_CASE(rules, 0.9 if e == 'canonical' else 0.8)} AS x FROM j WHERE {where}" for e, (where, rules) in _RULES.items())}),
verdicts AS (SELECT id, url, element, x.issue AS issue, floor(x.confidence * 1000 + 0.5) / 1000.0::DOUBLE AS confidence, CASE WHEN x.issue = 'keep' THEN 0 ELSE floor(least(1, CASE page_type WHEN 'service_page' THEN 0.95::DOUBLE WHEN 'blog_article' THEN 0.6::DOUBLE WHEN 'company_homepage' THEN 1.0::DOUBLE WHEN 'ecommerce_product' THEN 0.85::DOUBLE ELSE 0.35::DOUBLE END * weight
  * CASE WHEN rank IS NULL THEN 0.6::DOUBLE WHEN rank <= 3 THEN 0.4::DOUBLE WHEN rank <= 10 THEN 1.0::DOUBLE WHEN rank <= 30 THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END * (x.confidence * 0.5::DOUBLE + 0.5::DOUBLE)) * 1000 + 0.5) / 1000.0::DOUBLE END AS impact FROM v)"""
_F = lambda b: f"CASE WHEN ({b}) THEN 1.0::DOUBLE WHEN NOT ({b}) THEN 0.0::DOUBLE END"
_OPT = _WEIGHTED([
    ("title_coverage", 0.18), (_F("in_h1"), 0.14), ("CASE WHEN length(title) BETWEEN 25 AND 65 THEN 1.0 WHEN length(title) BETWEEN 15 AND 24 OR length(title) BETWEEN 66 AND 80 THEN 0.5 ELSE 0.0 END", 0.06), (f"CASE WHEN coalesce({_D}, 0) BETWEEN 70 AND 170 THEN 1.0 WHEN coalesce({_D}, 0) > 0 THEN 0.5 ELSE 0.0 END", 0.08),
    (_F("h1 = 1"), 0.06), ("h2 / 4.0::DOUBLE", 0.1), (_F("id % 3 = 0"), 0.04), (_F("id % 5 = 0"), 0.04), (_F("len(schema_types) > 0"), 0.08), ("CASE WHEN images = 0 THEN 0.5::DOUBLE ELSE images_alt / images::DOUBLE END", 0.05), ("CASE WHEN canonical_self THEN 1.0 ELSE 0.0 END", 0.04), (_F("viewport"), 0.04), (_F("https"), 0.04), (_F("NOT noindex"), 0.05),
])
_PARTS_SQL = {
    "content": _WEIGHTED([(_K(7, 5), 0.35), (_K(11, 3), 0.25), (f"1 - ({_K(13, 2)})", 0.15), ("CASE WHEN words IS NULL THEN 1.0::DOUBLE ELSE least(1, words / 800.0::DOUBLE) END", 0.25)]), "trust": _WEIGHTED([(_K(17, 2), 0.3), (_K(19, 3), 0.3), (_K(23, 4), 0.25), (_F("id % 2 = 0"), 0.15)]),
    "conversion": _WEIGHTED([(_K(29, 3), 0.4), (_K(31, 3), 0.25), (_F("id % 3 = 0"), 0.2), (_F("id % 2 = 0"), 0.15)]),
}
_HINTS = "((id % 2 = 0)::INT * 0.25::DOUBLE + (id % 3 = 0)::INT * 0.25::DOUBLE + (id % 5 = 0)::INT * 0.25::DOUBLE + (id % 7 = 0)::INT * 0.25::DOUBLE)"
_R3 = lambda x: f"floor(({x}) * 1000 + 0.5) / 1000.0::DOUBLE"
_NUM = "regexp_extract(html, '<p>([^<]*)', 1)"

from .keywords import SPACES  # noqa: E402
from .text import _LOOSE, _WS_TRIM  # noqa: E402

ORACLE_SQL = {
    "signal_rules": _SIGNAL_SQL,
    "element_rules": f"WITH {_VERDICTS} SELECT url, element, issue, confidence, impact FROM verdicts",
    "rewriting_rules": f"WITH {_VERDICTS} SELECT url, sum(floor(impact * 1000 + 0.5)::BIGINT)::BIGINT AS impact_milli, count(*) AS changes FROM verdicts WHERE element IN ('title', 'meta', 'h1', 'intro') AND issue <> 'keep' GROUP BY url ORDER BY impact_milli DESC, url LIMIT 24",
    "element_order": f"WITH {_VERDICTS} SELECT id, element, issue, impact, row_number() OVER (ORDER BY impact DESC, confidence DESC, id, element)::INT AS place FROM verdicts QUALIFY place <= 40",
    "score_rules": f"WITH {_FACTS}, s AS (SELECT id, {_OPT} AS optimization, {', '.join(f'{v} AS {k}' for k, v in _PARTS_SQL.items())} FROM facts) SELECT *, {_WEIGHTED([('content', 0.4), ('optimization', 0.25), ('trust', 0.2), ('conversion', 0.15)])} AS overall FROM s",
    "criteria_rules": f"""WITH {_FACTS} SELECT id, {_K(7, 5)} AS answer, {_K(11, 3)} AS facts, {_R3(f"CASE WHEN id % 2 = 0 THEN least(1, id % 7 / 4.0::DOUBLE) ELSE (least(1, id % 7 / 4.0::DOUBLE) + {_S(13)}) / 2 END")} AS sources, {_R3(f"CASE WHEN id % 2 = 0 THEN least(1, {_HINTS} * 0.7::DOUBLE + 0.15::DOUBLE) ELSE {_HINTS} * 0.5::DOUBLE + {_S(17)} * 0.5::DOUBLE END")} AS author,
CASE WHEN faq_schema THEN CASE WHEN id % 4 >= 3 OR id % 4 = 0 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END WHEN faq_section THEN 0.55::DOUBLE WHEN id % 3 >= 2 THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END AS faq, CASE WHEN id % 6 = 0 THEN NULL WHEN id % 30 <= 6 THEN 1.0::DOUBLE WHEN id % 30 >= 24 THEN 0.1::DOUBLE ELSE {_R3("1 - (id % 30 - 6) / 18.0::DOUBLE * 0.9::DOUBLE")} END AS fresh,
CASE WHEN id % 2 > 0 THEN 1.0::DOUBLE WHEN id % 5 >= 3 THEN 0.7::DOUBLE WHEN id % 5 >= 1 THEN 0.4::DOUBLE ELSE 0.1::DOUBLE END AS compare, {_R3("least(1, links_in / greatest(6.0::DOUBLE, coalesce(words, 0) / 150.0::DOUBLE))")} AS links, CASE id % 4 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.45::DOUBLE WHEN 2 THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END AS richness FROM facts""",
    "expected_schema": f"""WITH {_FACTS}, e AS (SELECT page_type, CASE page_type WHEN 'service_page' THEN list_contains(schema_types, 'Service') WHEN 'company_homepage' THEN false WHEN 'ecommerce_product' THEN false WHEN 'blog_article' THEN false END AS expected FROM facts) SELECT page_type, expected, count(*) AS pages FROM e GROUP BY ALL""",
    "keyword_flags": _M + f"""WITH {_URL_SQL}, r AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract_all(html, '<h1>([^<]*)</h1>', 1) AS h1, {_NUM} AS body, array_to_string((string_split({_NUM}, ' '))[1:2], ' ') AS keyword FROM pages),
k0 AS (SELECT *, {_KW.format('keyword')} AS kw, lr_terms(title) AS tt, lr_terms(body) AS bt, [lr_terms(x) FOR x IN h1] AS ht, lr_spelled(regexp_replace(regexp_extract(url, '^https?://([^?#]*)', 1), '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS slug0, [[lr_stem(w), w] FOR w IN lr_words(keyword) IF NOT lr_stop(w)] AS forms0 FROM r),
k1 AS (SELECT *, [[lr_spelled(f[1]), lr_spelled(f[2]), f[1]] FOR f IN forms0] AS forms1 FROM k0), k AS (SELECT *, lr_once(slug0) AS slug, [[lr_once(f[1]), lr_once(f[2]), f[3]] FOR f IN forms1] AS forms FROM k1),
t AS (SELECT *, len(list_distinct([f[3] FOR f IN forms IF length(f[1]) >= 4 OR length(f[2]) >= 4])) AS testable, len(list_distinct([f[3] FOR f IN forms IF length(f[1]) >= 4 AND contains(slug, f[1]) OR length(f[2]) >= 4 AND contains(slug, f[2])])) AS hits FROM k),
c AS (SELECT *, coalesce(len(list_intersect(kw, tt)) / nullif(len(kw), 0)::DOUBLE, 0) AS tc, coalesce(len(list_intersect(kw, bt)) / nullif(len(kw), 0)::DOUBLE, 0) AS bc FROM t)
SELECT page_id, tc >= 0.999 AS in_title, len([x FOR x IN ht IF coalesce(len(list_intersect(kw, x)) / nullif(len(kw), 0)::DOUBLE, 0) >= 0.999]) > 0 AS in_h1, testable > 0 AND hits * 2 >= testable AS in_url, false AS in_meta, floor(tc * 1000 + 0.5) / 1000.0::DOUBLE AS title_coverage, bc AS body_coverage, len(kw) > 0 AND tt[1 : len(kw)] = kw AS starts_title FROM c""",
    "page_phrases": rf"""WITH r AS (SELECT page_id, trim(regexp_replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '{SPACES}', ' ', 'g')) AS h, trim(regexp_split_to_array(regexp_extract(html, '<title>([^<]*)</title>', 1), '\s+[|–—·•-]\s+|\s*[|–—·•]\s*')[1]) AS c FROM pages)
SELECT page_id, lower(CASE WHEN length(h) BETWEEN 4 AND 90 AND len(regexp_split_to_array(h, '\s+')) <= 12 THEN h WHEN length(c) BETWEEN 4 AND 90 AND len(regexp_split_to_array(c, '\s+')) <= 12 THEN c END) AS phrase FROM r""",
    "intro_texts": rf"""WITH b AS (SELECT doc_id AS doc, trim(regexp_replace(lower(string_split(text, chr(10))[1]), '{SPACES}', ' ', 'g')) AS head, [trim(regexp_replace(x, '{SPACES}', ' ', 'g')) FOR x IN regexp_split_to_array(text, '
+')] AS blocks FROM documents)
SELECT doc, md5(array_to_string(([x FOR x IN blocks IF length(x) >= 40 AND trim(regexp_replace(lower(x), '{SPACES}', ' ', 'g')) <> head])[1:2], ' ')) AS intro FROM b""",
    "question_catalogue": "SELECT set, kind, count(*) AS questions, max(levels)::INT AS levels FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {d})" for a, b, c, d in judge.QUESTIONS) + ") t(set, question_id, kind, levels) GROUP BY set, kind",
    "applicable_questions": f"""WITH {_FACTS}, q AS (SELECT unnest([x FOR x IN [CASE WHEN coalesce(title, '') <> '' THEN 'title_clear' END, CASE WHEN coalesce(title, '') <> '' THEN 'title_specific' END, CASE WHEN coalesce(description, '') <> '' THEN 'meta_inviting' END, CASE WHEN h1 > 0 THEN 'h1_matches' END,
CASE WHEN length(coalesce(intro, '')) >= 60 THEN 'intro_direct' END, CASE WHEN words >= 300 AND h2 > 0 THEN 'outline_logical' END, CASE WHEN id % 4 > 0 THEN 'faq_useful' END] IF x IS NOT NULL]) AS question_id FROM facts) SELECT question_id, count(*) AS pages FROM q GROUP BY question_id""",
    "judge_requests": """WITH s AS (SELECT sha1('{"lang":"' || lang || '","source":"' || source || '"}' || chr(10) || 'a,b') AS request FROM documents), n AS (SELECT request, count(*) AS pages, ('0x' || left(request, 4))::INT AS n FROM s GROUP BY request)
SELECT request, pages, CASE WHEN n % 3 <> 0 THEN (n % 100)::VARCHAR END AS answer, n % 3 = 0 AS failed FROM n""",
    "judged_slices": """WITH q AS (SELECT doc_id AS entity_id, o, CASE WHEN (doc_id + o) % 7 <> 0 AND doc_id % 6 <> 0 OR doc_id % 4 = 0 THEN (doc_id + o) * 7 % 101 / 100.0::DOUBLE END AS p FROM labels, range(12) t(o))
SELECT entity_id, floor(max(p) FILTER (o = 4) * 1000 + 0.5) / 1000.0::DOUBLE AS depth, floor(max(p) FILTER (o = 10) * 1000 + 0.5) / 1000.0::DOUBLE AS cta, CASE count(p) WHEN 0 THEN 'none' WHEN 12 THEN 'complete' ELSE 'partial' END AS status FROM q GROUP BY entity_id""",
    "screened_keywords": "WITH k AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY p_name) SELECT CASE k % 2 WHEN 0 THEN 'transactional' ELSE 'informational' END AS intent, count(*) AS keywords, max(k * 7 % 101 / 100.0::DOUBLE) AS best FROM k WHERE k % 4 <> 0 GROUP BY 1",
    "judge_cost": "SELECT count(*) AS calls, sum(length(text))::BIGINT AS input_tokens, sum(length(text))::BIGINT * 0.25::DOUBLE / 1000000 AS usd FROM conversations",
    "offline_judge": f"""WITH {_FACTS}, o AS (SELECT id, CASE WHEN words IS NOT NULL THEN {_R3("least(1, words / 1500.0::DOUBLE) * 0.7::DOUBLE + least(1, h2 / 8.0::DOUBLE) * 0.3::DOUBLE")} END AS topic_depth, {_R3("greatest(0, least(1, 1 - least(1, (id % 4 + id % 2) / 6.0::DOUBLE) * 0.8::DOUBLE - 0.1::DOUBLE))")} AS generic_content,
CASE WHEN id % 3 > 0 THEN 0.85::DOUBLE ELSE 0.15::DOUBLE END AS states_prices, CASE WHEN id % 5 = 0 OR id % 2 = 0 THEN 0.85::DOUBLE ELSE 0.15::DOUBLE END AS shows_identity, CASE WHEN length(coalesce(title, '')) BETWEEN 25 AND 62 THEN 0.85::DOUBLE ELSE 0.15::DOUBLE END AS title_clear,
CASE WHEN id % 3 <> 0 THEN 1.0::DOUBLE END AS h1_matches, CASE WHEN h2 > 0 THEN {_R3("least(1, h2 / 6.0::DOUBLE)")} END AS outline_logical, CASE WHEN words > 0 THEN 0.1::DOUBLE END AS specific_facts, CASE WHEN id % 4 >= 2 THEN 0.75::DOUBLE ELSE 0.2::DOUBLE END AS cites_sources FROM facts)
SELECT * FROM o""",
    "worst_citability": f"WITH r AS (SELECT id::VARCHAR AS url, {_WEIGHTED([(_K(7, 5), 0.5), (_K(11, 3), 0.5)])} AS now FROM (SELECT doc_id AS id FROM documents)) SELECT url, now, row_number() OVER (ORDER BY now ASC NULLS LAST, url)::INT AS place FROM r QUALIFY place <= 50",
    "answer_filter_counts": f"WITH {_RECORDS} SELECT engine, count(*) AS all, count(*) FILTER (status IN ('cited', 'named')) AS won, count(*) FILTER (status = 'missing') AS lost FROM recs GROUP BY engine",
    "question_texts": """WITH r AS (SELECT conv_id AS question_id, md5(text) AS text FROM conversations WHERE role = 'user'), a AS (SELECT question_id, min(text) AS a FROM r WHERE question_id % 3 <> 0 GROUP BY 1), b AS (SELECT question_id, min(text) AS b FROM r WHERE question_id % 2 = 0 GROUP BY 1)
SELECT question_id, coalesce(a, b) AS text FROM a FULL JOIN b USING (question_id)""",
    "winner_order": f"WITH {_A}, {_CITE}, w AS (SELECT domain, count(DISTINCT answer_id) AS cited_in, max(ordinal) * 1.5::DOUBLE AS score10 FROM c WHERE NOT own GROUP BY domain) SELECT *, row_number() OVER (ORDER BY cited_in DESC, score10 DESC, domain)::INT AS place FROM w QUALIFY place <= 5",
    "visible_domains": f"WITH {_A}, {_CITE}, n AS (SELECT engine, domain, own, count(DISTINCT answer_id) AS n FROM c GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY engine ORDER BY n DESC, domain)::INT AS place FROM n QUALIFY place <= 3 OR own",
    "page_type_shares": "WITH t AS (SELECT p_brand AS keyword, (" + str(W.PAGE_TYPES) + """)[p_partkey * p_size % 10 + 1] AS page_type FROM part), n AS (SELECT keyword, page_type, count(*) AS n FROM t GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY keyword) AS a FROM n)
SELECT keyword, page_type, n, floor((n * 2000 + a) / (2 * a)) / 1000.0::DOUBLE AS share, row_number() OVER (PARTITION BY keyword ORDER BY n DESC, page_type)::INT AS place FROM s QUALIFY place <= 3""",
    "report_search": "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'and#1') OR p_partkey % 3 <> 0 AND contains(lower(p_brand), 'and#1')",
    "running_jobs": "SELECT o_orderpriority AS kind, ['queued', 'running'][o_orderkey % 4 + 1] AS status, count(*) AS jobs FROM orders WHERE o_orderkey % 4 < 2 GROUP BY ALL",
    "usage_rows": "SELECT event_type AS service, count(*) AS calls, sum(event_id % 900)::BIGINT AS tokens, CASE WHEN count(*) FILTER (event_type = 'error' AND event_id % 5 = 0) = 0 THEN sum(event_id % 70)::BIGINT END AS cost_micro, count(*) FILTER (event_id % 9 = 0) AS failed FROM events GROUP BY event_type",
    "run_status": """WITH r AS (SELECT source AS site, CASE WHEN doc_id % 29 = 0 THEN 'b' WHEN doc_id % 31 = 0 THEN 't' ELSE 'ok' END AS f, doc_id % 23 = 0 AS part FROM documents),
s AS (SELECT site, count(*) AS pages, count(*) FILTER (f = 'b') AS b, count(*) FILTER (f = 't') AS u, count(*) FILTER (f = 'ok' AND part) AS i FROM r GROUP BY site)
SELECT site, pages, CASE WHEN u + i > 0 THEN 'partial' ELSE 'complete' END AS status, array_to_string([x FOR x IN [CASE WHEN b > 0 THEN 'robots.txt forbids ' || b END, CASE WHEN u > 0 THEN 'could not open ' || u END, CASE WHEN i > 0 THEN 'judged in part ' || i END] IF x IS NOT NULL], '; ') AS warnings FROM s""",
    "output_checks": """WITH r AS (SELECT quality, toxic, n_chars, source FROM documents LEFT JOIN labels USING (doc_id)) SELECT 'judged' AS rule, count(*) FILTER (quality IS NULL) AS rows FROM r UNION ALL SELECT 'long_enough', count(*) FILTER (NOT coalesce(n_chars >= 100, false)) FROM r
UNION ALL SELECT 'one_sign', count(*) FILTER (NOT coalesce(quality + toxic <= 1, false)) FROM r UNION ALL SELECT 'named', count(*) FILTER (NOT coalesce(source <> '', false)) FROM r""",
    "engine_rows": f"""WITH {_RECORDS}, f AS (SELECT engine, count(*) AS asked, count(*) FILTER (status = 'missing') AS missing, sum(answer_id % 4)::BIGINT AS searches, CASE WHEN count(*) FILTER (engine = 'gamma' AND answer_id % 3 = 0) = 0 THEN sum(answer_id % 50)::BIGINT END AS cost_micro FROM recs GROUP BY engine),
n AS (SELECT c.engine, domain, count(DISTINCT answer_id) AS n FROM c JOIN recs USING (answer_id) WHERE status = 'missing' AND domain <> 'site4' GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY engine ORDER BY n DESC, domain) AS place FROM n QUALIFY place <= 4),
l AS (SELECT engine, string_agg(domain, ',' ORDER BY place) AS d FROM t GROUP BY engine) SELECT f.*, coalesce(d, '') AS cited_instead FROM f LEFT JOIN l USING (engine)""",
    "ai_shares": f"WITH {_RECORDS}, came AS (SELECT answer_id FROM recs WHERE status <> 'failed'), n AS (SELECT domain, count(DISTINCT answer_id) AS n FROM c JOIN came USING (answer_id) GROUP BY domain), t AS (SELECT count(*) AS a FROM came) SELECT domain, floor((n * 2000 + a) / (2 * a)) / 1000.0::DOUBLE AS share FROM n, t",
    "answer_records": _M + f"""WITH {_RECORDS}, s AS (SELECT answer_id, status, {_WS_TRIM.format('text')} AS x FROM recs), h AS (SELECT *, left(x, 499) AS head FROM s), p AS (SELECT *, CASE WHEN contains(head, ' ') THEN length(head) - strpos(reverse(head), ' ') END AS pos FROM h)
SELECT answer_id, status, md5(CASE WHEN length(x) <= 500 THEN x ELSE rtrim(CASE WHEN pos > 300 THEN left(head, pos) ELSE head END) || '…' END) AS excerpt FROM p""",
    "competitor_order": f"WITH r AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'steal' ELSE 'weak' END AS verdict, {_K(7, 3)} AS overall FROM (SELECT doc_id AS id FROM documents)) SELECT *, row_number() OVER (ORDER BY (verdict = 'steal')::INT DESC, coalesce(overall, 0) DESC, id)::INT AS place FROM r QUALIFY place <= 30",
    "criteria_weights": "SELECT * FROM (VALUES ('answer', 0.22::DOUBLE, 1), ('facts', 0.17, 2), ('sources', 0.14, 3), ('author', 0.12, 4), ('faq', 0.1, 5), ('fresh', 0.1, 6), ('compare', 0.08, 7), ('links', 0.07, 8)) t(criterion, weight, place)",
    "brief_notes": """WITH b AS (SELECT p_brand, count(*) AS pages, sum(p_size)::BIGINT AS target FROM part GROUP BY p_brand) SELECT p_brand, 'Write a service page of about ' || target || ' words; ' || pages || ' pages were compared.' AS summary,
array_to_string([x FOR x IN ['length ' || (target // 2) || '-' || (target * 2), CASE WHEN pages >= 5 THEN 'keyword first in the title' END, CASE WHEN pages % 3 > 0 THEN 'cover ' || (pages % 3) || ' terms' END, CASE WHEN pages % 2 > 0 THEN 'answer the questions' END, 'add questions with markup'] IF x IS NOT NULL], '; ') AS checklist FROM b""",
    "plan_markdown": r"""WITH p AS (SELECT p_partkey AS place, [p_name || ' *https://x.example*', p_type, '[a]' || p_brand] AS c FROM part), q AS (SELECT place, [regexp_replace(regexp_replace(x, '([\\`*_{}\[\]()#+|<>!~-])', '\\\1', 'g'), '(?i)(https?):', '\1\\:', 'g') FOR x IN c] AS c FROM p)
SELECT place, '## ' || c[1] || chr(10) || chr(10) || '- [ ] ' || c[2] || chr(10) || '- [ ] ' || c[3] || chr(10) AS text FROM q""",
    "run_estimates": """SELECT * FROM (VALUES ('run', 10, 15, 16, 'searches', 16), ('run', 10, 15, 16, 'pages', 10), ('run', 10, 15, 16, 'judgments', 195), ('run', 20, 45, 40, 'searches', 46), ('run', 20, 45, 40, 'pages', 20), ('run', 20, 45, 40, 'judgments', 555),
('audit', 100, 60, 3, 'pages', 100), ('audit', 100, 60, 3, 'judgments', 480), ('audit', 100, 60, 3, 'engine_calls', 150), ('audit', 100, 60, 3, 'seed_searches', 3), ('audit', 5, 0, 0, 'pages', 5), ('audit', 5, 0, 0, 'judgments', 15), ('audit', 5, 0, 0, 'engine_calls', 0), ('audit', 5, 0, 0, 'seed_searches', 0)) t(kind, a, b, c, what, n)""",
    "seeded_draws": """WITH h AS (SELECT p_partkey, list_reduce(list_prepend(2166136261::UBIGINT, [ord(x)::UBIGINT FOR x IN string_split(p_name, '')]), lambda a, x: (xor(a, x) * 16777619) % 4294967296) AS h FROM part),
a AS (SELECT *, (h + 1831565813) % 4294967296 AS a FROM h), b AS (SELECT *, ((xor(a, a >> 15))::HUGEINT * (a | 1)::HUGEINT % 4294967296)::UBIGINT AS t FROM a),
c AS (SELECT *, xor(t, (t + ((xor(t, t >> 7))::HUGEINT * (t | 61)::HUGEINT % 4294967296)::UBIGINT) % 4294967296) AS u FROM b) SELECT p_partkey, h::BIGINT AS hash, xor(u, u >> 14) / 4294967296.0::DOUBLE AS drawn, 'abcdef' AS options FROM c""",
    "figures_as_text": """WITH r AS (SELECT p_partkey, p_partkey % 101 / 100.0::DOUBLE AS rate, greatest(p_partkey % 101 / 100.0::DOUBLE - p_partkey % 7 / 100.0::DOUBLE, 0) AS low, least(p_partkey % 101 / 100.0::DOUBLE + p_partkey % 5 / 100.0::DOUBLE, 1) AS high, p_partkey * 37 % 3000 AS ms, p_partkey % 40 / 32.0::DOUBLE AS usd FROM part),
f AS (SELECT *, floor(rate * 100 + 0.5)::BIGINT AS r, floor(low * 100 + 0.5)::BIGINT AS a, floor(high * 100 + 0.5)::BIGINT AS b FROM r)
SELECT p_partkey, r || '%' AS share, r || '% (' || CASE WHEN a = b THEN a || '%' ELSE a || '–' || b || '%' END || ')' AS span, CASE WHEN ms <= 0 THEN '—' WHEN ms < 1000 THEN ms || ' ms' ELSE printf('%.1f', floor(ms / 100.0::DOUBLE + 0.5) / 10) || ' s' END AS latency, CASE WHEN usd <= 0 THEN '$0' ELSE '$' || printf('%.2f', floor(usd * 100 + 0.5) / 100) END AS usd FROM f""",
    "page_questions": _M + "SELECT conv_id, turn, least(12, len(list_distinct([x FOR x IN string_split(text, chr(10)) IF lr_asks(x)])))::INT AS questions FROM conversations WHERE role = 'assistant'",
}

_OWN = [f"o.id * {3 * i + 7} % 11 / 8.0::DOUBLE" for i in range(4)]
ORACLE_SQL["debiased_choices"] = f"""WITH o AS (SELECT doc_id AS id FROM documents), w AS (SELECT id, {', '.join(f'{x} AS b{i}' for i, x in enumerate(_OWN))} FROM o),
t AS (SELECT *, b0 + 0.25::DOUBLE + b1 + b2 + b3 AS total, id % 7 = 0 AS failed FROM w),
m AS (SELECT id, failed, [((b0 + 0.25::DOUBLE) / total + b0 / total) / 2, (b1 / total + b1 / total) / 2, (b2 / total + b2 / total) / 2, (b3 / total + (b3 + 0.25::DOUBLE) / total) / 2] AS p FROM t),
r AS (SELECT id, failed, CASE WHEN NOT failed THEN list_sort([(-p[i], i) FOR i IN range(1, 5)]) END AS r FROM m)
SELECT id, {KINDS}[r[1][2]] AS value, floor(-r[1][1] * 1000 + 0.5) / 1000.0::DOUBLE AS p, {KINDS}[r[2][2]] AS runner_up,
  CASE WHEN NOT failed THEN floor(least(1, greatest(0, (-r[1][1] - 0.25::DOUBLE) / 0.75::DOUBLE)) * 1000 + 0.5) / 1000.0::DOUBLE END AS confidence, failed FROM r"""
