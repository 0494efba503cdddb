"""Queries over crawled pages: addresses, facts, robots, site maps, links."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import domains, html, sites
from ..sources.shared import spread, written
from ..sources.tables import read_table

NOW = datetime(2026, 10, 5, tzinfo=timezone.utc)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages")


def normalize_page_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    rows = _pages(spark, sf_dir).select("page_id", "url", U.page_address(u).alias("p"))
    return rows.select("page_id", U.page_identity(u).alias("identity"), U.compare_form(u).alias("compared"), "p.url", "p.key", F.col("p.depth").alias("depth"), U.problem(u).alias("problem"), U.for_judge(u).alias("judged"))


def page_url_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.distinct_pages(_pages(spark, sf_dir), F.col("url"), "page_id")


def registrable_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = U.host(F.col("url"))
    rows = _pages(spark, sf_dir).select(U.registrable(F.col("url")).alias("domain"), h.alias("host"), U.is_hostname(h).alias("valid"), U.is_own(h, F.lit("example.org")).alias("own"))
    return rows.groupBy("domain", "valid", "own").agg(F.count(F.lit(1)).alias("pages"), F.count_distinct("host").alias("hosts"))


def typed_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users type for a site, put right."""
    typed = F.concat(F.lit("  HTTPS://user@WWW."), F.upper(U.host(F.col("url"))), F.lit(".:8080/x?y"))
    return _pages(spark, sf_dir).select("page_id", U.normalize_domain(typed).alias("domain"))


def html_facts_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    count = lambda p: F.size(F.regexp_extract_all(h, F.lit(f"({p})"), F.lit(1))).cast("long")
    bare = F.regexp_replace(F.regexp_replace(h, r"(?s)<(?:script|style|title)\b.*?</(?:script|style|title)>", " "), r"(?s)<[^>]*>", " ")
    return _pages(spark, sf_dir).select(
        "page_id", F.regexp_extract(h, r"<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(h, r'<html lang="([^"]*)"', 1).alias("lang"), count("<a ").alias("links"), count("<h1>").alias("h1"),
        count("<p>").alias("paragraphs"), F.size(T.words(bare)).alias("words"), F.startswith(F.col("url"), F.lit("https:")).alias("https"),
    )


def html_facts_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = html.page_facts(_pages(spark, sf_dir), NOW, limits=html.Limits(None, None, None, None, None))
    cols = ("status", "title", "lang", "words", "h1", "h2", "links_in", "links_out", "images", "tables", "lists", "https", "viewport", "noindex", "author", "form", "phones", "emails", "latest_year", "modified_at")
    return f.select("page_id", *[F.col(f"facts.{c}").alias(c) for c in cols], F.size("facts.headings").alias("headings"), F.size("facts.nav").alias("nav"))


def _made_page(k, name, kind):
    """A page whose facts follow from a number: how often each kind of element stands in it, in frames and in the main part, shown and hidden."""
    part = lambda text, rule=None: F.lit(text) if rule is None else F.when(rule, F.lit(text)).otherwise("")
    times = lambda text, n: F.repeat(F.lit(text), n.cast("int"))
    # numbered, as a heading like the one before it does not count
    heads = lambda level, n: F.array_join(F.transform(F.slice(F.array(*[F.lit(i) for i in range(1, 6)]), F.lit(1), n.cast("int")), lambda i: F.concat(F.lit(f"<h{level}>Head "), i.cast("string"), F.lit(f"</h{level}>"))), "")
    return F.concat(
        F.lit('<!doctype html><html lang="'), F.get(F.array(F.lit("en"), F.lit("bg"), F.lit("de")), (k % 3).cast("int")), F.lit('"><head><title>Title  of\n'), name, F.lit("</title>"),
        F.when(k % 4 != 0, F.concat(F.lit('<meta name="description" content="About '), kind, F.lit('">'))).otherwise(""), part("<meta name=viewport content='width=device-width'>", k % 2 == 0), part('<META NAME="robots" CONTENT="NOINDEX, follow">', k % 7 == 0),
        F.when(k % 5 == 1, F.lit('<link rel="canonical" href="https://other.example/x">')).when(k % 5 > 1, F.concat(F.lit('<link rel=canonical href="https://www.made.example/p'), k.cast("string"), F.lit('/">'))).otherwise(""),
        F.when(k % 4 == 2, F.concat(F.lit('<meta property="article:modified_time" content="2026-01-0'), (k % 9 + 1).cast("string"), F.lit('">'))).otherwise(""), part('<meta name="author" content="A. Body">', k % 3 == 2),
        part('<script type="application/ld+json">{"@type": "Product"}</script>', k % 6 == 1), part('<script type="application/ld+json">{"@graph": [{"@type": ["FAQPage", "WebPage"], "mainEntity": [{"@type": "Question", "name": "Why?"}]}]}</script>', k % 6 == 2),
        F.lit("<style>p { color: red }</style></head><body>"), part('<nav><a href="/home">home</a> <a href="/all">all</a></nav>', k % 2 == 1), F.lit("<main>"), heads(1, k % 2 + 1), heads(2, k % 4), heads(3, k % 5),
        F.lit("<p>"), times("word ", k % 50), F.when(k % 3 == 1, F.concat(F.lit("in "), (k % 15 + 2010).cast("string"))).otherwise(""), F.lit("</p><p hidden>hidden text</p><div style='display: none'>more</div><script>var a = '<p>none</p>';</script>"),
        times('<a href="/inner">in</a> ', k % 5), part('<a href="https://one.example/">out</a> ', k % 3 >= 1), part('<a href="https://two.example/a?b">out</a> ', k % 3 >= 2), part('<a href="#top">top</a> '), part('<a href="tel:+359 888 123 456">ring</a> ', k % 3 == 0),
        part('<a href="mailto:a@made.example?subject=x">write</a> ', k % 4 == 1), times('<img src=a.png alt="a">', k % 3), times("<img src=b.png>", k % 4), times("<table><tr><td>cell<td>cell</tr><tr><td>cell<td>cell</table>", k % 3), part("<table><tr><td>row</table>"),
        times("<ul><li>item<li>item<li>item</ul>", k % 4), part("<ul><li>item<li>item</ul>"), part("<form><textarea></textarea></form>", k % 5 == 0), part("<form role=search><input name=q></form>"), F.lit("</main><footer>foot note</footer></body></html>"),
    )


def made_page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that the parser finds on a page made for each part, whose counts follow from the part's number."""
    k = F.col("p_partkey")
    # dealt out as parts: the pages are many times their size, and one task may read them all
    parts = spread(read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"))
    rows = parts.select("p_partkey", F.concat(F.lit("https://made.example/p"), k.cast("string")).alias("url"), _made_page(k, F.col("p_name"), F.col("p_type")).alias("html"))
    f = html.page_facts(rows, NOW)
    cols = "title description lang viewport noindex canonical_self https h1 h2 h3 words links_in links_out external_domains images images_alt tables lists form phones emails latest_year modified_at author faq_schema".split()
    return f.select("p_partkey", *[F.col(f"facts.{c}").alias(c) for c in cols], F.size("facts.schema_types").alias("schema_types"), F.size("facts.nav").alias("nav"), F.array_join("facts.faq_questions", "|").alias("asked"), F.size("facts.cut").alias("cut"))


def link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by host: how many, to how many pages, how many leave the host."""
    links = html.link_table(_pages(spark, sf_dir), most=None, chars=None).withColumn("host", U.host(F.col("from_url")))
    return links.groupBy("host").agg(F.count(F.lit(1)).alias("links"), F.count_distinct(U.page_identity(F.col("to_url"))).alias("targets"), F.count_if(U.host(F.col("to_url")) != F.col("host")).alias("leaving"))


def link_crawl_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by distance from page 0, where page i links to 2i+1 and 2i+2."""
    ids = _pages(spark, sf_dir).select("page_id")
    edges = ids.select(F.col("page_id").cast("string").alias("from_key"), F.explode(F.array((F.col("page_id") * 2 + 1).cast("string"), (F.col("page_id") * 2 + 2).cast("string"))).alias("to_key"))
    return sites.crawl_order(edges, "0", 62).groupBy("level").agg(F.count(F.lit(1)).alias("pages"))


def site_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the address found first, where redirects and canonical links, made up from the ids, run in chains, cycles and stars."""
    rows = _pages(spark, sf_dir).select("page_id", "url", U.host(F.col("url")).alias("host"))
    k = F.col("page_id") % 10
    to = F.when(k < 3, F.col("page_id") + 3).when(k == 7, F.col("page_id") + 1).when(k == 8, F.col("page_id") - 1).when(k == 9, F.col("page_id") - 9)
    other = rows.select(F.col("page_id").alias("to"), F.col("url").alias("other"))
    pairs = rows.withColumn("to", to).join(other, "to").select("url", "other")
    return sites.merge_aliases(rows.select("host", F.col("page_id").alias("ordinal"), "url"), pairs).select("host", "key", "url", "ordinal", "names")


def site_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl of every host over the links of its pages; an address that is no page of the table is answered by the page of its
    host whose number is the length of the address, counted round, and what robots rules close is not read."""
    rows = _pages(spark, sf_dir).select("page_id", "url", U.host(F.col("url")).alias("host"))
    count = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    numbered = rows.withColumn("nth", F.row_number().over(Window.partitionBy("host").orderBy("page_id")) - 1)
    links = written(html.link_table(_pages(spark, sf_dir), most=None, chars=None), "site-links")
    asked = rows.select("url").unionByName(links.select(F.col("to_url").alias("url"))).select(U.page_address(F.col("url")).alias("p"), U.host(F.col("url")).alias("host")).where("p is not null").select("host", "p.key", "p.url").groupBy("host", "key").agg(F.min("url").alias("url"))
    files = count.select("host", F.lit(200).alias("status"), F.lit("User-agent: *\nDisallow: /t\n").alias("text"))
    named = asked.select(F.col("key").alias("id"), "host", U.path_and_query(F.col("url")).alias("path"))
    open_ = sites.allowed(named, sites.robots_rules(files, "Somebot/1.0")).where("allowed").select(F.col("id").alias("key"))
    served = asked.join(open_, "key", "left_semi").join(count, "host").withColumn("nth", (F.length("key") % F.col("pages")).cast("int"))
    found = served.join(numbered.select("host", "nth", F.col("url").alias("from_url")), ["host", "nth"]).join(links, "from_url")
    homes = numbered.where("nth = 0").select("host", F.concat(F.lit("https://"), "host", F.lit("/")).alias("asked"), "url")
    return sites.crawl(homes, found.select(F.col("key").alias("from_key"), "ordinal", "to_url"), 2, 5, 25)


#: Suffix rules: all kinds, of labels that the pages' hosts have.
SUFFIX_RULES = [("com", False), ("net", False), ("org", False), ("example.org", False), ("*.example.net", False), ("!m.example.net", False), ("example.com", True), ("blog.example.org", True)]


def suffix_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrable domains of the pages' hosts, by the public rules and with the private ones."""
    rules = spark.createDataFrame(SUFFIX_RULES, "rule string, private boolean")
    full = F.lower(F.regexp_extract("url", r"^https?://([^/?#:@]+)", 1))
    rows = _pages(spark, sf_dir).select("page_id", full.alias("host"))
    public = domains.with_registrable(rows, rules, private=False).select("page_id", "host", F.col("suffix").alias("public_suffix"), F.col("registrable").alias("public_domain"))
    return domains.with_registrable(public, rules).select("page_id", "host", "public_suffix", "public_domain", "suffix", F.col("registrable").alias("domain"))


_ROBOTS = "User-agent: *\nDisallow: /en/1\nAllow: /en/1*5\nDisallow: /*.html$\n\nUser-agent: Fixbot # ours\nUser-agent: other\nDisallow: /fr/\nAllow: /\nSitemap: https://a.example/s.xml\nsitemap: /t.xml # here\n"


def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir).select(F.col("page_id").alias("id"), U.host(F.col("url")).alias("host"), U.path_and_query(F.col("url")).alias("path"))
    hosts = rows.select("host").distinct()
    n = F.length("host") % 4
    files = hosts.select("host", F.when(n == 0, 404).when(n == 1, 503).otherwise(200).alias("status"), F.lit(_ROBOTS).alias("text"))
    agent = "Somebot/1.0 (+https://somebot.example)"
    return sites.allowed(rows, sites.robots_rules(files, agent)).select("id", "allowed")


def robots_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = _pages(spark, sf_dir).select(U.host(F.col("url")).alias("host")).distinct().withColumn("text", F.lit(_ROBOTS))
    return sites.sitemaps_of_robots(hosts).select("host", "url")


def sitemap_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site maps of each host, made of its pages, read back and deduplicated."""
    entry = F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    # as sites do it: files of a bounded number of addresses
    rows = _pages(spark, sf_dir).groupBy(U.host(F.col("url")).alias("source"), F.floor(F.col("page_id") / 10_000).alias("file"))
    files = rows.agg(F.concat(F.lit('<?xml version="1.0"?><urlset>'), F.array_join(F.sort_array(F.collect_list(entry)), "\n"), F.lit("</urlset>")).alias("text"))
    found = sites.sitemap_urls(files, None, None, None)
    return found.groupBy("source", "kind").agg(F.count(F.lit(1)).alias("urls"), F.count_distinct(U.page_address(F.col("url"))["key"]).alias("pages"))


def public_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which addresses a crawler may open, for pages and for forms that hide private ones."""
    hidden = F.get(F.array(*[F.lit(x) for x in ("http://10.0.0.1/", "http://[::ffff:127.0.0.1]/", "ftp://a.example/", "http://u:p@a.example/", "http://a.example:22/", "http://localhost/", "https://93.184.216.34/")]), (F.col("page_id") % 7).cast("int"))
    rows = _pages(spark, sf_dir).select(F.explode(F.array("url", hidden)).alias("url"))
    return rows.groupBy(U.is_public(F.col("url")).alias("public")).agg(F.count(F.lit(1)).alias("addresses"))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_page_url, page_url_dedupe, registrable_domains, typed_domains, html_facts_regex, html_facts_extract, made_page_facts, link_graph, link_crawl_levels, site_aliases, site_crawl, suffix_domains, robots_allowed, robots_sitemaps, sitemap_pages, public_addresses,
    )
}

_LIST = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_URL_SQL = rf"""u AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:@]+)', 1)), '^www\d?\.', '') AS host, lower(regexp_extract(url, '^https?://([^/?#@]+)', 1)) AS full_host,
  regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q, lower(regexp_extract(url, '^(https?)://', 1)) AS scheme FROM pages),
v AS (SELECT *, CASE WHEN path = '' THEN '/' ELSE path END AS p, [x FOR x IN string_split(q, '&') IF x <> '' AND NOT starts_with(lower(string_split(x, '=')[1]), 'utm_') AND lower(string_split(x, '=')[1]) NOT IN {_LIST(U.TRACKING)}] AS kept,
  [x FOR x IN string_split(lower(CASE WHEN path = '' THEN '/' ELSE path END), '/') IF x <> ''] AS segs FROM u),
w AS (SELECT *, coalesce(segs[-1], '') AS last_seg, CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS tail FROM v),
x AS (SELECT *, len([s FOR s IN segs IF s IN {_LIST(U.SEGMENTS)}]) > 0 OR last_seg IN {_LIST(U.FILES)} OR (contains(last_seg, '.') AND string_split(last_seg, '.')[-1] IN {_LIST(U.EXTENSIONS)}) OR len(kept) > 2
  OR len([k FOR k IN kept IF lower(string_split(k, '=')[1]) IN {_LIST(U.ACTIONS)}]) > 0 AS bad FROM w),
addr AS (SELECT *, CASE WHEN NOT bad THEN scheme || '://' || full_host || p || tail END AS page_url, CASE WHEN NOT bad THEN regexp_replace(full_host, '^www\.', '') || regexp_replace(p, '/+$', '') || tail END AS key, CASE WHEN NOT bad THEN len(segs)::INT END AS depth FROM x)"""

ORACLE_SQL = {
    "normalize_page_url": rf"""WITH {_URL_SQL} SELECT page_id, host || regexp_replace(path, '/+$', '') AS identity, lower(scheme || '://' || host || regexp_replace(path, '/+$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END) AS compared,
page_url AS url, key, depth, CASE WHEN len([k FOR k IN string_split(q, '&') IF k <> '']) >= 2 THEN 'parameters' WHEN regexp_matches(path, '[A-Z]') THEN 'capitals' WHEN contains(path, '_') THEN 'underscore' WHEN length(path) > 90 THEN 'long'
  WHEN regexp_full_match(string_split(regexp_replace(path, '/+$', ''), '/')[-1], '\d+|[0-9a-f]{{16,}}') THEN 'opaque' END AS problem, left(regexp_extract(url, '^[^?#]*'), 200) AS judged FROM addr""",
    "page_url_dedupe": f"WITH {_URL_SQL} SELECT key, arg_min(page_url, page_id) AS url, arg_min(depth, page_id) AS depth, min(page_id) AS ordinal FROM addr WHERE NOT bad GROUP BY key",
    "registrable_domains": rf"""WITH {_URL_SQL} SELECT array_to_string(string_split(host, '.')[-2:], '.') AS domain, regexp_full_match(host, '([a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?\.)+[a-z]{{2,63}}') AS valid, host = 'example.org' OR ends_with(host, '.example.org') AS own,
count(*) AS pages, count(DISTINCT host) AS hosts FROM addr GROUP BY ALL""",
    "typed_domains": f"WITH {_URL_SQL} SELECT page_id, host AS domain FROM addr",
    "html_facts_regex": r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, len(regexp_extract_all(html, '<a ')) AS links, len(regexp_extract_all(html, '<h1>')) AS h1,
len(regexp_extract_all(html, '<p>')) AS paragraphs, len(regexp_extract_all(lower(regexp_replace(regexp_replace(html, '(?s)<(script|style|title)\b.*?</(script|style|title)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')), '[\p{L}\p{N}]+'))::INT AS words,
starts_with(url, 'https:') AS https FROM pages""",
    "link_crawl_levels": """SELECT lvl::INT AS level, count(*) AS pages FROM (SELECT DISTINCT k, min(floor(log2(k + 1))) AS lvl FROM (SELECT 0 AS k UNION ALL SELECT page_id * 2 + 1 FROM pages UNION ALL SELECT page_id * 2 + 2 FROM pages) GROUP BY k) GROUP BY lvl""",
    "robots_allowed": rf"""WITH {_URL_SQL}, rules(allow, pattern, size) AS (VALUES (false, '^/en/1', 5), (true, '^/en/1.*5', 7), (false, '^/.*\.html$', 7)),
t AS (SELECT page_id, host, regexp_extract(url, '^https?://[^/?#]*([^#]*)', 1) AS rest FROM u), pq AS (SELECT page_id, host, CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END AS path FROM t),
best AS (SELECT page_id, arg_max(allow, size * 2 + allow::INT) AS allow FROM pq JOIN rules ON regexp_matches(path, pattern) GROUP BY page_id)
SELECT page_id AS id, CASE length(host) % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE coalesce(allow, true) END AS allowed FROM pq LEFT JOIN best USING (page_id)""",
    "robots_sitemaps": f"WITH {_URL_SQL} SELECT DISTINCT host, s AS url FROM u, LATERAL (SELECT unnest(['https://a.example/s.xml', 'https://' || host || '/t.xml']) AS s)",
}

ORACLE_SQL |= {
    "sitemap_pages": f"WITH {_URL_SQL} SELECT host AS source, 'urls' AS kind, count(*) AS urls, count(DISTINCT key) AS pages FROM addr GROUP BY host",
    "public_addresses": "SELECT public, count(*) AS addresses FROM (SELECT true AS public FROM pages UNION ALL SELECT page_id % 7 = 6 FROM pages) GROUP BY public",
}

ORACLE_SQL |= {
    "link_graph": rf"""WITH {_URL_SQL}, l AS (SELECT url, unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1)) AS h FROM pages)
SELECT host, count(*) AS links, count(DISTINCT host || regexp_replace(regexp_extract(h, '^[^?#]*'), '/+$', '')) AS targets, 0::BIGINT AS leaving FROM l JOIN (SELECT DISTINCT url, host FROM u) USING (url) WHERE h <> '' GROUP BY host""",
}

_LINKED = r"""l AS (SELECT page_id, url, i - 1 AS ordinal, h[i] AS h FROM (SELECT page_id, url, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '<a[^>]*href="([^"]+)"', 1) AS h FROM pages))),
t AS (SELECT page_id, ordinal, regexp_extract(url, '^https?://[^/?#]*') || replace(h, '&amp;', '&') AS to_url FROM l)"""
_ASKED = "a(page_id, url) AS (SELECT page_id, url FROM pages UNION SELECT NULL, to_url FROM t)"

ORACLE_SQL |= {
    "site_aliases": f"""WITH RECURSIVE {_URL_SQL}, o AS (SELECT *, CASE WHEN page_id % 10 < 3 THEN page_id + 3 WHEN page_id % 10 = 7 THEN page_id + 1 WHEN page_id % 10 = 8 THEN page_id - 1 WHEN page_id % 10 = 9 THEN page_id - 9 END AS other FROM addr),
e AS (SELECT a.key AS u, b.key AS v FROM o a JOIN o b ON a.other = b.page_id WHERE a.key IS NOT NULL AND b.key IS NOT NULL), both_ AS (SELECT u, v FROM e UNION SELECT v, u FROM e), nodes AS (SELECT DISTINCT key FROM addr WHERE key IS NOT NULL),
reach(k, x) AS (SELECT key, key FROM nodes UNION SELECT r.k, b.v FROM reach r JOIN both_ b ON b.u = r.x), page AS (SELECT k AS key, min(x) AS page, count(*) AS names FROM reach GROUP BY k)
SELECT arg_min(host, (page_id, key, page_url)) AS host, arg_min(key, (page_id, key, page_url)) AS key, arg_min(page_url, (page_id, key, page_url)) AS url, min(page_id) AS ordinal, any_value(names)::BIGINT AS names FROM addr JOIN page USING (key) GROUP BY page""",
    "site_crawl": f"""WITH {_LINKED}, {_ASKED}, {_URL_SQL.replace("FROM pages)", "FROM a)", 1)},
n AS (SELECT page_id, url, host, row_number() OVER (PARTITION BY host ORDER BY page_id) - 1 AS nth, count(*) OVER (PARTITION BY host) AS pages FROM addr WHERE page_id IS NOT NULL),
k AS (SELECT host, key, min(page_url) AS url FROM addr WHERE key IS NOT NULL GROUP BY ALL), c AS (SELECT DISTINCT host, pages FROM n),
open AS (SELECT k.host, k.key, length(k.key) % c.pages AS nth FROM k JOIN c USING (host) WHERE NOT starts_with(regexp_extract(k.url, '^https?://[^/?#]*([^#]*)', 1), '/t')),
links AS (SELECT o.host, o.key AS from_key, t.ordinal, x.key, x.page_url AS url, x.depth FROM open o JOIN n USING (host, nth) JOIN t USING (page_id) JOIN (SELECT DISTINCT url AS to_url, key, page_url, depth FROM addr WHERE key IS NOT NULL) x USING (to_url)),
home AS (SELECT n.host, x.key, x.page_url AS url, x.depth FROM n JOIN addr x USING (page_id) WHERE nth = 0 AND x.key IS NOT NULL),
one AS (SELECT l.host, l.key, arg_min(l.url, (l.ordinal, l.url)) AS url, min(l.depth) AS depth, min(l.ordinal) AS ordinal FROM links l JOIN home h ON h.host = l.host AND h.key = l.from_key WHERE l.key <> h.key AND l.key <> l.host GROUP BY l.host, l.key),
first AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ordinal, key) AS nth, count(*) OVER (PARTITION BY host) AS found FROM one),
two AS (SELECT l.host, l.key, min((f.nth, l.ordinal, l.url, l.depth)) AS o FROM links l JOIN first f ON f.host = l.host AND f.key = l.from_key AND f.nth <= 4 WHERE l.key <> l.host AND NOT EXISTS (SELECT 1 FROM home h WHERE h.host = l.host AND h.key = l.key) AND NOT EXISTS (SELECT 1 FROM one x WHERE x.host = l.host AND x.key = l.key) GROUP BY l.host, l.key),
brought AS (SELECT f.host, f.nth, f.found, count(two.key) AS n FROM first f LEFT JOIN two ON two.host = f.host AND two.o[1] = f.nth WHERE f.nth <= 4 GROUP BY ALL),
turns AS (SELECT *, 1 + found + coalesce(sum(n) OVER (PARTITION BY host ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 25 AS go FROM brought),
second AS (SELECT two.host, two.key, two.o[3] AS url, two.o[4] AS depth, row_number() OVER (PARTITION BY two.host ORDER BY two.o[1], two.o[2], two.key) AS nth FROM two JOIN turns u ON u.host = two.host AND u.nth = two.o[1] AND u.go),
every AS (SELECT host, key, url, depth, 0 AS level, 0 AS found_at FROM home UNION ALL SELECT host, key, url, depth, 1, nth FROM first UNION ALL SELECT s.host, s.key, s.url, s.depth, 2, s.nth + (SELECT count(*) FROM one x WHERE x.host = s.host) FROM second s),
left_ AS (SELECT host, bool_or(nth > 4) AS over FROM first GROUP BY host), stopped AS (SELECT host, bool_or(NOT go) AS stopped FROM turns GROUP BY host)
SELECT host, key, url, level::INT AS level, found_at::BIGINT AS found_at, row_number() OVER (PARTITION BY host ORDER BY level > 0, depth, found_at)::INT AS place, coalesce(over, false) OR coalesce(stopped, false) OR count(*) OVER (PARTITION BY host) > 25 AS truncated
FROM every LEFT JOIN left_ USING (host) LEFT JOIN stopped USING (host) QUALIFY place <= 25""",
    "suffix_domains": r"""WITH r(rule, private) AS (VALUES """ + ", ".join(f"('{r}', {str(p).lower()})" for r, p in SUFFIX_RULES) + r"""),
h AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:@]+)', 1)) AS host FROM pages), d AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM h WHERE host <> ''),
e AS (SELECT host, len(l) AS size, i, array_to_string(l[i:], '.') AS own, array_to_string(l[i + 1:], '.') AS rest FROM d, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)),
m AS (SELECT host, private, CASE WHEN rule = '!' || own THEN (1, size - i) ELSE (0, size - i + 1) END AS best FROM e JOIN r ON rule = own OR rule = '*.' || rest OR rule = '!' || own),
b AS (SELECT d.host, l, coalesce(max(best) FILTER (NOT private), (0, 1))[2] AS p, coalesce(max(best), (0, 1))[2] AS n FROM d LEFT JOIN m USING (host) GROUP BY ALL)
SELECT page_id, host, array_to_string(l[len(l) - p + 1:], '.') AS public_suffix, CASE WHEN len(l) > p THEN array_to_string(l[len(l) - p:], '.') END AS public_domain,
  array_to_string(l[len(l) - n + 1:], '.') AS suffix, CASE WHEN len(l) > n THEN array_to_string(l[len(l) - n:], '.') END AS domain FROM h LEFT JOIN b USING (host)""",
}

ORACLE_SQL["made_page_facts"] = """SELECT p_partkey, 'Title of ' || p_name AS title, CASE WHEN k % 4 <> 0 THEN 'About ' || p_type END AS description, ['en', 'bg', 'de'][k % 3 + 1] AS lang, k % 2 = 0 AS viewport, k % 7 = 0 AS noindex,
CASE WHEN k % 5 > 0 THEN k % 5 > 1 END AS canonical_self, true AS https, (k % 2 + 1)::INT AS h1, (k % 4)::INT AS h2, (k % 5)::INT AS h3,
((k % 2 + 1) * 2 + k % 4 * 2 + k % 5 * 2 + k % 50 + CASE WHEN k % 3 = 1 THEN 2 ELSE 0 END + k % 5 + k % 3 + 1 + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 4 = 1 THEN 1 ELSE 0 END + 4 * (k % 3) + 1 + 3 * (k % 4) + 2)::INT AS words,
(k % 5 + CASE WHEN k % 2 = 1 THEN 2 ELSE 0 END)::INT AS links_in, (k % 3)::INT AS links_out, (k % 3)::INT AS external_domains, (k % 3 + k % 4)::INT AS images, (k % 3)::INT AS images_alt, (k % 3)::INT AS tables, (k % 4)::INT AS lists, k % 5 = 0 AS form,
(k % 3 = 0)::INT AS phones, (k % 4 = 1)::INT AS emails, CASE WHEN k % 3 = 1 THEN k % 15 + 2010 END::INT AS latest_year, CASE WHEN k % 4 = 2 THEN '2026-01-0' || (k % 9 + 1) || 'T00:00:00Z' END AS modified_at, k % 3 = 2 AS author,
k % 6 = 2 AS faq_schema, CASE k % 6 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END::INT AS schema_types, CASE WHEN k % 2 = 1 THEN 2 ELSE 0 END::INT AS nav, CASE WHEN k % 6 = 2 THEN 'Why?' ELSE '' END AS asked, 0 AS cut FROM (SELECT *, p_partkey AS k FROM part)"""
