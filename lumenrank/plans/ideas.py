"""Queries of keyword ideas, fetched pages, engines' raw answers and site discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import urls as U
from ..functions import weights as W
from ..operators import collect, fetch, ideas, opportunities, phrases, ranking, sites
from ..sources import adapters, demo, results_json
from ..sources.shared import spread
from ..sources.tables import read_table
from .pages import _URL_SQL, _pages
from .serp import RESULTS_SQL, serp_results
from .text import _KW, _M, _TOKENS, _docs

SEED = "small ring"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").withColumn("ordinal", F.col("p_partkey").cast("long"))


def candidate_ideas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ideas for one seed from all six sources."""
    part = _parts(spark, sf_dir)
    some = lambda n, text: part.where(F.col("p_partkey") % 5 == n).select("ordinal", text.alias("text"), (F.col("p_size") % 6).cast("long").alias("pages"))
    name, kind = F.col("p_name"), F.col("p_type")
    out = ideas.generate_candidates(SEED, some(0, F.concat(F.lit("  Best "), name, F.lit("??"))), some(1, F.concat(F.lit("how much is a "), name, F.lit("?"))), some(2, F.concat(name, F.lit(" "), kind)), some(3, F.concat(name, F.lit(" guide"))), some(4, F.lower(F.substring_index(kind, " ", 1))), some(0, F.concat(name, F.lit(" for "), F.lower(kind))), "en")
    return out.select("key", "keyword", F.array_join("sources", ",").alias("sources"), "pages", "place")


def local_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which keywords name a city, inflected or not."""
    city = F.get(F.array(*[F.lit(c) for c in [*ideas.CITIES, "lom", ""]]), (F.col("p_partkey") % 22).cast("int"))
    rows = spread(_parts(spark, sf_dir)).select(city.alias("city"), F.concat("p_name", F.lit(" "), city).alias("keyword"))
    return rows.groupBy("city", ideas.has_local_modifier(F.col("keyword")).alias("local")).agg(F.count(F.lit(1)).alias("keywords"))


def keyword_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes asked for each keyword once, unknown ones null."""
    asked = results_json.wanted_volumes(_parts(spark, sf_dir).select(F.concat(F.lit(" "), F.upper("p_name"), F.lit("  "), "p_brand").alias("keyword"), "ordinal"))
    known = _parts(spark, sf_dir).groupBy(F.lower(F.concat("p_name", F.lit(" "), "p_brand")).alias("keyword")).agg(F.max(F.when(F.col("p_partkey") % 3 != 0, F.col("p_size") * 10)).alias("volume"))
    return asked.join(known, "keyword", "left").select("keyword", "volume")


def candidate_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = serp_results(spark, sf_dir)
    picked = results.select("keyword").distinct()
    judged = results.where("key % 3 <> 0").select("keyword", "url", F.lit("service_page").alias("page_type")).distinct()
    failed = picked.where(F.length("keyword") == 8)
    return ideas.candidate_results(picked, results.where(F.length("keyword") != 8), judged, failed)


def crawl_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    targets = pages.select(F.col("page_id").alias("ordinal"), F.col("page_id").cast("string").alias("url"))
    came = targets.where("ordinal % 4 <> 0").select("url", F.when(F.col("ordinal") % 5 == 0, "http_error").otherwise("ok").alias("status"))
    return ideas.crawl_targets(targets, came, 40).groupBy("status").agg(F.count(F.lit(1)).alias("pages"))


def seed_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = _parts(spark, sf_dir)
    share = lambda m: k * m % 101 / F.lit(100.0)
    results = rows.select(k.cast("string").alias("url"), share(3).alias("title_match"))
    deep = rows.where(k % 3 == 0).select(k.cast("string").alias("url"), F.lit("service_page").alias("page_type"), share(7).alias("dedicated"), share(11).alias("depth"), F.when(k % 2 == 0, share(13)).alias("title_coverage"))
    shallow = rows.where(k % 5 != 0).select(k.cast("string").alias("url"), F.lit("blog_article").alias("page_type"), share(17).alias("dedicated"))
    out = ideas.seed_signals(results, deep, shallow)
    return out.withColumn("agrees", ideas.intent_agrees(F.when(F.col("page_type") == "blog_article", "informational").when(F.col("deep"), "transactional"), F.lit("transactional")))


def best_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to write for an intent and a dominant type."""
    pick = lambda values, c: F.get(F.array(*[F.lit(v) for v in values]), (c % len(values)).cast("int"))
    k = F.col("p_partkey")
    rows = _parts(spark, sf_dir).select(pick(["transactional", "informational", "commercial_investigation", "navigational"], k).alias("intent"), F.when(k % 3 != 0, pick(W.PAGE_TYPES, k * 3)).alias("page_type"))
    return rows.groupBy("intent", "page_type", opportunities.best_format(F.col("page_type"), F.col("intent")).alias("format")).agg(F.count(F.lit(1)).alias("keywords"))


def must_cover_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases on two fifths of a language's pages, without parts of longer ones: mined, pruned, ranked."""
    docs = _docs(spark, sf_dir)
    counts = docs.groupBy(F.col("lang").alias("scope")).agg(F.count(F.lit(1)).alias("all"))
    least = counts.select("scope", F.ceil(F.col("all") * 2 / F.lit(5.0)).alias("least"))
    common = phrases.mine_phrases(docs, least_pages=2, scope=F.col("lang"), least_of=least).join(counts, "scope")
    kept = ranking.top_per(phrases.prune_subsumed(common), ["scope"], [F.desc("pages"), F.desc("n"), F.desc("total"), F.col("key")], 15, "place")
    return kept.select("scope", "key", "pages", N.ratio3(F.col("pages"), F.col("all")).alias("share"), "place")


def fetch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    kind = F.get(F.array(*[F.lit(x) for x in ("text/html; charset=utf-8", "application/pdf", "TEXT/HTML", "application/xhtml+xml", "")]), (k % 5).cast("int"))
    status = fetch.page_status(k % 7 != 0, k % 11 != 0, k % 8, F.when(k % 13 != 0, F.when(k % 6 == 0, 404).otherwise(200)), kind)
    return _pages(spark, sf_dir).groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("pages"))


def capped_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = fetch.capped(F.encode("html", "UTF-8"), 4000)
    return _pages(spark, sf_dir).select("page_id", F.octet_length(body["body"]).alias("bytes"), body["truncated"].alias("truncated"))


def robots_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules by host from recorded fetches: none in time blocks the host."""
    k = F.col("page_id")
    hosts = _pages(spark, sf_dir).groupBy(U.host(F.col("url")).alias("host")).agg(F.min("page_id").alias("page_id"))
    files = fetch.robots_files(hosts.select("host", F.lit(200).alias("status"), (k % 8).alias("redirects"), (k * 97 % 9000).alias("ms"), F.lit("User-agent: *\nDisallow: /private").alias("text")), None)
    rules = sites.robots_rules(files, "bot")
    return rules.select("host", F.size("rules").alias("rules"), F.get("rules", F.lit(0))["head"].alias("first"))


def engine_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw answers of three interfaces, made of conversations, read to one table."""
    rows = read_table(spark, sf_dir, "conversations").where("role = 'assistant'").withColumn("answer_id", F.col("conv_id") * 1000 + F.col("turn"))
    url = lambda i: F.concat(F.lit("https://site"), ((F.col("answer_id") + i) % 9).cast("string"), F.lit(".example/p"))
    tokens = F.struct(F.length("text").alias("input_tokens"), (F.length("text") + 1).alias("output_tokens"))
    link = lambda i: F.struct(url(i).alias("url"), F.lit("t").alias("title"))
    null = lambda kind: F.lit(None).cast(kind)
    call = F.struct(F.lit("web_search_call").alias("type"), F.struct(F.lit("q  one").alias("query"), F.array(F.struct(url(3).alias("url"))).alias("sources")).alias("action"), null("array<struct<type: string, text: string, annotations: array<struct<type: string, url: string, title: string>>>>").alias("content"))
    said = F.struct(F.lit("message").alias("type"), null("struct<query: string, sources: array<struct<url: string>>>").alias("action"), F.array(F.struct(F.lit("output_text").alias("type"), F.col("text").alias("text"), F.array(F.struct(F.lit("url_citation").alias("type"), url(1).alias("url"), F.lit("t").alias("title"))).alias("annotations"))).alias("content"))
    one = F.to_json(F.struct(F.lit("m1").alias("model"), tokens.alias("usage"), F.array(call, said).alias("output")))
    links = "array<struct<url: string, title: string>>"
    block = lambda kind, text, query, content, cites: F.struct(F.lit(kind).alias("type"), text.alias("text"), F.struct(query.alias("query")).alias("input"), content.alias("content"), cites.alias("citations"))
    two = F.to_json(F.struct(F.lit("m2").alias("model"), tokens.alias("usage"), F.array(block("server_tool_use", null("string"), F.lit("q two"), null(links), null(links)), block("web_search_tool_result", null("string"), null("string"), F.array(link(3), link(4)), null(links)), block("text", F.col("text"), null("string"), null(links), F.array(link(1)))).alias("content")))
    web = lambda i: F.struct(F.struct(url(i).alias("uri"), F.lit("t").alias("title")).alias("web"))
    ground = F.struct(F.array(F.lit("q three"), F.lit("q three"), F.lit("")).alias("webSearchQueries"), F.array(web(1), web(2), web(3)).alias("groundingChunks"), F.array(F.struct(F.array(F.lit(0), F.lit(2)).alias("groundingChunkIndices"))).alias("groundingSupports"))
    three = F.to_json(F.struct(F.lit("m3").alias("modelVersion"), F.struct(F.length("text").alias("promptTokenCount"), F.lit(0).alias("candidatesTokenCount"), F.length("text").alias("totalTokenCount")).alias("usageMetadata"), F.array(F.struct(F.struct(F.array(F.struct("text")).alias("parts")).alias("content"), ground.alias("groundingMetadata"))).alias("candidates")))
    read = lambda n, json, reader: reader(rows.where(F.col("conv_id") % 3 == n).select("answer_id", json.alias("json")), None, None)
    both = read(0, one, adapters.output_answers).unionByName(read(1, two, adapters.content_answers)).unionByName(read(2, three, adapters.part_answers))
    cites = adapters.raw_citations(both).groupBy("answer_id").agg(F.count_if(F.col("kind") == "cited").alias("cited"), F.count_if(F.col("kind") == "consulted").alias("consulted"), F.min(F.when(F.col("kind") == "cited", F.col("url"))).alias("first"))
    return both.select("answer_id", F.md5("text").alias("text"), "model", "input_tokens", "output_tokens", F.array_join("queries", "|").alias("queries")).join(cites, "answer_id")


def redirect_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains of redirect links from their titles, and token counts from whichever key has them."""
    k = F.col("p_partkey")
    rows = _parts(spark, sf_dir).select("p_partkey", F.when(k % 2 == 0, F.concat(F.lit("https://redirect.example/r?"), k.cast("string"))).otherwise("https://www.shop.example/x").alias("url"), F.when(k % 3 == 0, "News.Example").when(k % 3 == 1, "not a host").otherwise("a.b.example").alias("title"))
    return rows.select("p_partkey", collect.redirect_domain(F.col("url"), F.col("title"), "redirect.example").alias("domain"), collect.first_positive(k % 4, k % 5, k + 1).alias("tokens"))


def site_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each host: from the first site map that has any, else from links; at most twenty a host."""
    rows = _pages(spark, sf_dir).select(F.col("page_id").alias("ordinal"), U.host(F.col("url")).alias("host"), "url").where(U.page_address(F.col("url")).isNotNull())
    home = rows.groupBy("host").agg(F.min_by("url", "ordinal").alias("u")).select("host", F.concat(F.regexp_extract("u", r"^(https?://[^/?#]+)", 1), F.lit("/")).alias("url"))
    mapped = rows.where(F.length("host") % 2 == 0).select("host", (F.col("ordinal") % 2).alias("rank"), "ordinal", "url")
    return sites.discover(home, mapped, rows, 20)


def demo_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.volumes(_parts(spark, sf_dir).select(F.col("p_name").alias("keyword")))


def demo_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each made-up site comes first, and among the first three."""
    rows = demo.results(_parts(spark, sf_dir).select(F.concat("p_name", F.lit(" "), "p_brand").alias("keyword")))
    return rows.groupBy("domain").agg(F.count_if(F.col("position") == 1).alias("first"), F.count_if(F.col("position") <= 3).alias("top3"), F.count(F.lit(1)).alias("seen"))


QUERIES = {
    f.__name__: f
    for f in (
        demo_volumes, demo_results, candidate_ideas, local_keywords, keyword_volumes, candidate_results, crawl_plan, seed_signals, best_formats, must_cover_phrases, fetch_outcomes, capped_bodies, robots_fetches, engine_answers, redirect_domains, site_discovery,
    )
}

#: The mined phrases of each language by itself, on two fifths of its pages.
_SCOPED = _TOKENS
for _was, _now in (
    ("segs AS (SELECT doc_id AS doc,", "segs AS (SELECT doc_id AS doc, lang AS scope,"), ("toks AS (SELECT doc,", "toks AS (SELECT doc, scope,"), ("runs AS (SELECT doc,", "runs AS (SELECT doc, scope,"), ("(SELECT doc, n::INT AS n", "(SELECT doc, scope, n::INT AS n"),
    ("(SELECT a.key,", "(SELECT a.scope, a.key,"), ("(SELECT key, n, sum(c)", "(SELECT scope, key, n, sum(c)"), ("(SELECT key, n, surface, count(*) AS c FROM good GROUP BY ALL) GROUP BY key, n)", "(SELECT scope, key, n, surface, count(*) AS c FROM good GROUP BY ALL) GROUP BY scope, key, n)"),
    ("(SELECT key, count(DISTINCT doc) AS pages FROM good GROUP BY key HAVING count(DISTINCT doc) >= 3) b USING (key)", "(SELECT scope, key, count(DISTINCT doc) AS pages FROM good JOIN langs USING (scope) GROUP BY scope, key, of_lang HAVING count(DISTINCT doc) >= greatest(2, ceil(of_lang * 0.4::DOUBLE))) b USING (scope, key)"),
):
    assert _was in _SCOPED
    _SCOPED = _SCOPED.replace(_was, _now)

_SUFFIX, _PREFIX = ideas.MODIFIERS["en"]
_VARIED = ", ".join(f"({i}, '{t}')" for i, t in enumerate([f"{SEED} {m}" for m in _SUFFIX] + [f"{m} {SEED}" for m in _PREFIX]))
_TERMS = _KW.format("text")

_HASH = lambda text: f"list_reduce(list_prepend(2166136261::UBIGINT, [ord(x)::UBIGINT FOR x IN string_split({text}, '')]), lambda a, x: (xor(a, x) * 16777619) % 4294967296)"
#: The nth number drawn from a hash h, in three steps: a, t, u.
_DRAWN = """{0}a AS (SELECT *, (h + 1831565813::UBIGINT * {1}) % 4294967296 AS a FROM {2}), {0}b AS (SELECT *, ((xor(a, a >> 15))::HUGEINT * (a | 1)::HUGEINT % 4294967296)::UBIGINT AS t FROM {0}a),
{0}c AS (SELECT *, xor(t, (t + ((xor(t, t >> 7))::HUGEINT * (t | 61)::HUGEINT % 4294967296)::UBIGINT) % 4294967296) AS u FROM {0}b), {0} AS (SELECT * EXCLUDE (a, t, u), xor(u, u >> 14) / 4294967296.0::DOUBLE AS {0}_drawn FROM {0}c)"""

ORACLE_SQL = {
    "demo_volumes": f"WITH k AS (SELECT DISTINCT p_name AS keyword FROM part), h AS (SELECT keyword, {_HASH("'volume|' || keyword")} AS h FROM k), {_DRAWN.format('one', 1, 'h')}, {_DRAWN.format('two', 2, 'one')} SELECT keyword, CASE WHEN one_drawn >= 0.12 THEN (floor(two_drawn * 200) * 10 + 10)::BIGINT END AS volume FROM two",
    "demo_results": f"""WITH k AS (SELECT DISTINCT p_name || ' ' || p_brand AS keyword FROM part), s AS (SELECT keyword, domain FROM k, (SELECT unnest({[d for d, _ in demo.SITES]}) AS domain)), h AS (SELECT *, {_HASH("'rank|' || keyword || '|' || domain")} AS h FROM s), {_DRAWN.format('one', 1, 'h')},
p AS (SELECT domain, row_number() OVER (PARTITION BY keyword ORDER BY one_drawn DESC, domain) AS position FROM one) SELECT domain, count(*) FILTER (position = 1) AS first, count(*) FILTER (position <= 3) AS top3, count(*) AS seen FROM p WHERE position <= 10 GROUP BY domain""",
    "candidate_ideas": _M + f"""WITH b AS (SELECT p_partkey::BIGINT AS ordinal, p_partkey % 5 AS g, p_name AS name, p_type AS kind, (p_size % 6)::BIGINT AS pages FROM part),
r AS (SELECT 0 AS part, ordinal, '  Best ' || name || '??' AS text, 0::BIGINT AS pages, 'related' AS source FROM b WHERE g = 0 UNION ALL SELECT 1, ordinal, 'how much is a ' || name || '?', 0, 'people_also_ask' FROM b WHERE g = 1 UNION ALL SELECT 2, ordinal, name || ' ' || kind, 0, 'autocomplete' FROM b WHERE g = 2
UNION ALL SELECT 3, ordinal, name || ' guide', pages, 'competitor_terms' FROM b WHERE g = 3 UNION ALL SELECT 4, ordinal, '{SEED} ' || lower(string_split(kind, ' ')[1]), pages, 'competitor_terms' FROM b WHERE g = 4 AND length(string_split(kind, ' ')[1]) >= 4
UNION ALL SELECT 5, ordinal, name || ' for ' || lower(kind), pages, 'competitor_terms' FROM b WHERE g = 0 UNION ALL SELECT 6, i, t, 0, 'modifier' FROM (VALUES {_VARIED}) v(i, t) UNION ALL SELECT 9, 0, '{SEED}', 0, ''),
d AS MATERIALIZED (SELECT text, {_TERMS} AS terms FROM (SELECT DISTINCT text FROM r)), own AS MATERIALIZED (SELECT terms AS own FROM d WHERE text = '{SEED}'),
k AS (SELECT part, ordinal, lower(trim(regexp_replace(regexp_replace(text, '[?!]+$', ''), '\\s+', ' ', 'g'))) AS text, pages, source, terms, own, len(list_intersect(terms, own)) AS shared, array_to_string(list_sort(terms), ' ') AS key FROM r JOIN d USING (text), own WHERE part < 9),
w AS (SELECT *, row_number() OVER (PARTITION BY part, shared = len(own) AND len(terms) > len(own) ORDER BY ordinal) AS nth FROM k),
f AS (SELECT * FROM w WHERE CASE part WHEN 3 THEN pages >= 2 AND shared > 0 WHEN 4 THEN len(terms) > len(own) WHEN 5 THEN shared = len(own) AND len(terms) > len(own) AND nth <= 10 ELSE true END AND len(string_split(text, ' ')) BETWEEN 2 AND 9 AND length(text) <= 80 AND key <> '' AND key <> array_to_string(list_sort(own), ' ')),
g AS (SELECT key, arg_min(text, (part, ordinal)) AS keyword, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, max(pages) AS pages, min((part, ordinal)) AS o FROM f GROUP BY key)
SELECT key, keyword, sources, pages, row_number() OVER (ORDER BY o)::INT AS place FROM g QUALIFY place <= 80""",
    "local_keywords": f"SELECT c AS city, c NOT IN ('lom', '') AS local, count(*) AS keywords FROM (SELECT ({[*ideas.CITIES, 'lom', '']})[p_partkey % 22 + 1] AS c FROM part) GROUP BY ALL",
    "keyword_volumes": """WITH a AS (SELECT lower(p_name || ' ' || p_brand) AS keyword, min(p_partkey) AS o FROM part GROUP BY 1 ORDER BY o LIMIT 1000), v AS (SELECT lower(p_name || ' ' || p_brand) AS keyword, max(CASE WHEN p_partkey % 3 <> 0 THEN p_size * 10 END) AS volume FROM part GROUP BY 1)
SELECT keyword, volume FROM a LEFT JOIN v USING (keyword)""",
    "candidate_results": f"""WITH {RESULTS_SQL}, p AS (SELECT DISTINCT keyword FROM serp), t AS (SELECT * FROM serp WHERE length(keyword) <> 8 QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY position, url) <= 10)
SELECT p.keyword, count(t.url) AS results, count(*) FILTER (t.key % 3 <> 0) AS judged, length(p.keyword) = 8 AS failed FROM p LEFT JOIN t USING (keyword) GROUP BY p.keyword""",
    "crawl_plan": "WITH t AS (SELECT page_id, row_number() OVER (ORDER BY page_id) AS n FROM pages) SELECT CASE WHEN n > 40 THEN 'skipped' WHEN page_id % 4 = 0 THEN 'error' WHEN page_id % 5 = 0 THEN 'http_error' ELSE 'ok' END AS status, count(*) AS pages FROM t GROUP BY 1",
    "seed_signals": """WITH p AS (SELECT p_partkey AS k FROM part), s AS (SELECT k, k % 3 = 0 AS deep, k % 5 <> 0 AS shallow FROM p)
SELECT k::VARCHAR AS url, CASE WHEN deep THEN 'service_page' WHEN shallow THEN 'blog_article' END AS page_type, CASE WHEN deep THEN k * 7 % 101 / 100.0::DOUBLE WHEN shallow THEN k * 17 % 101 / 100.0::DOUBLE END AS dedicated, CASE WHEN deep THEN k * 11 % 101 / 100.0::DOUBLE END AS depth,
CASE WHEN deep AND k % 2 = 0 THEN k * 13 % 101 / 100.0::DOUBLE ELSE k * 3 % 101 / 100.0::DOUBLE END AS title_match, deep, CASE WHEN deep THEN true WHEN shallow THEN false END AS agrees FROM s""",
    "best_formats": f"""WITH r AS (SELECT ['transactional', 'informational', 'commercial_investigation', 'navigational'][p_partkey % 4 + 1] AS intent, CASE WHEN p_partkey % 3 <> 0 THEN ({W.PAGE_TYPES})[p_partkey * 3 % 10 + 1] END AS page_type FROM part)
SELECT intent, page_type, coalesce(page_type, CASE intent WHEN 'informational' THEN 'blog_article' WHEN 'comparison' THEN 'comparison_listicle' WHEN 'navigational' THEN 'company_homepage' ELSE 'service_page' END) AS format, count(*) AS keywords FROM r GROUP BY ALL""",
    "must_cover_phrases": _M + "WITH langs AS (SELECT lang AS scope, count(*) AS of_lang FROM documents GROUP BY lang), " + _SCOPED.lstrip() + """,
split_ AS MATERIALIZED (SELECT scope, string_split(key, ' ') AS w, n, pages FROM mined WHERE n > 1), inner_ AS (SELECT scope, unnest(list_concat(w, CASE WHEN n = 3 THEN [w[1] || ' ' || w[2], w[2] || ' ' || w[3]] ELSE [] END)) AS key, pages FROM split_), most AS (SELECT scope, key, max(pages) AS p FROM inner_ GROUP BY scope, key),
kept AS (SELECT mined.* FROM mined LEFT JOIN most USING (scope, key) WHERE coalesce(p, 0) < pages * 0.85::DOUBLE)
SELECT scope, key, pages, floor((pages * 2000 + of_lang) / (2 * of_lang)) / 1000.0::DOUBLE AS share, row_number() OVER (PARTITION BY scope ORDER BY pages DESC, n DESC, total DESC, key)::INT AS place FROM kept JOIN langs USING (scope) QUALIFY place <= 15""",
    "fetch_outcomes": "SELECT CASE WHEN page_id % 11 = 0 THEN 'blocked_address' WHEN page_id % 7 = 0 THEN 'blocked_robots' WHEN page_id % 13 = 0 THEN 'error' WHEN page_id % 8 > 5 THEN 'too_many_redirects' WHEN page_id % 6 = 0 THEN 'http_error' WHEN page_id % 5 = 1 THEN 'not_html' ELSE 'ok' END AS status, count(*) AS pages FROM pages GROUP BY 1",
    "capped_bodies": "SELECT page_id, least(strlen(html), 4000)::INT AS bytes, strlen(html) > 4000 AS truncated FROM pages",
    "robots_fetches": f"WITH {_URL_SQL}, h AS (SELECT host, min(page_id) AS k FROM u GROUP BY host) SELECT host, 1 AS rules, CASE WHEN k % 8 <= 5 AND k * 97 % 9000 <= 6000 THEN '/private' ELSE '/' END AS first FROM h",
    "engine_answers": """WITH a AS (SELECT conv_id * 1000 + turn AS answer_id, conv_id % 3 AS e, text FROM conversations WHERE role = 'assistant')
SELECT answer_id, md5(text) AS text, 'm' || (e + 1) AS model, length(text)::BIGINT AS input_tokens, CASE WHEN e = 2 THEN length(text) ELSE length(text) + 1 END::BIGINT AS output_tokens, ['q one', 'q two', 'q three'][e + 1] AS queries, CASE WHEN e = 2 THEN 2 ELSE 1 END::BIGINT AS cited, CASE WHEN e = 1 THEN 2 ELSE 1 END::BIGINT AS consulted,
CASE WHEN e = 2 THEN least('https://site' || ((answer_id + 1) % 9) || '.example/p', 'https://site' || ((answer_id + 3) % 9) || '.example/p') ELSE 'https://site' || ((answer_id + 1) % 9) || '.example/p' END AS first FROM a""",
    "redirect_domains": "SELECT p_partkey, CASE WHEN p_partkey % 2 <> 0 THEN 'shop.example' WHEN p_partkey % 3 = 0 THEN 'news.example' WHEN p_partkey % 3 = 2 THEN 'a.b.example' END AS domain, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 4 WHEN p_partkey % 5 > 0 THEN p_partkey % 5 ELSE p_partkey + 1 END AS tokens FROM part",
    "site_discovery": f"""WITH {_URL_SQL}, r AS (SELECT page_id AS ordinal, host, page_url AS url, key, depth FROM addr WHERE NOT bad), m AS (SELECT host, min(ordinal % 2) AS rank FROM r WHERE length(host) % 2 = 0 GROUP BY host),
h AS (SELECT host, arg_min(regexp_extract(url, '^(https?://[^/?#]+)', 1), ordinal) || '/' AS url FROM r GROUP BY host),
b AS (SELECT host, -1 AS ordinal, regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '^www\\.', ''), '/+$', '') AS key, url, -1 AS depth, 'home' AS via FROM h UNION ALL SELECT r.host, ordinal, key, url, depth, 'sitemap' FROM r JOIN m ON r.host = m.host AND ordinal % 2 = rank
UNION ALL SELECT host, ordinal, key, url, depth, 'links' FROM r WHERE host NOT IN (SELECT host FROM m)), o AS (SELECT host, key, min((depth, ordinal, url, via)) AS o FROM b GROUP BY ALL)
SELECT host, key, o[3] AS url, o[4] AS via, row_number() OVER w::INT AS place, count(*) OVER (PARTITION BY host) > 20 AS truncated FROM o WINDOW w AS (PARTITION BY host ORDER BY o[1], o[2], key) QUALIFY place <= 20""",
}
