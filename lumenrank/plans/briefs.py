"""Queries of briefs, collected citations and plans' details."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import briefs, collect, phrases
from ..sources.shared import written
from ..sources.tables import read_table
from .answers import _answers, _citations
from .serp import RESULTS_SQL, serp_results


OWN_SOURCE = "src12"  # stands for our own pages


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select(F.col("p_brand").alias("scope"), F.concat_ws(" ", "p_name", "p_type").alias("title"), F.substring_index("p_name", " ", 1).alias("keyword"))


def title_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return briefs.title_patterns(_titles(spark, sf_dir))


def title_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return briefs.title_words(_titles(spark, sf_dir))


def schema_type_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = F.array(F.lit("WebPage"), F.col("p_type"), F.col("p_type"), F.concat(F.lit("T"), (F.col("p_size") % 7).cast("string")))
    return briefs.schema_types(read_table(spark, sf_dir, "part").select(F.col("p_brand").alias("scope"), types.alias("types")), 3)


def trust_element_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = read_table(spark, sf_dir, "part").select(F.col("p_brand").alias("scope"), *[F.when(k % e != 0, (k * m % 11) / F.lit(10.0)).alias(c) for c, m, e in (("reviews", 3, 4), ("prices", 5, 3), ("contact", 7, 5))])
    return briefs.element_shares(rows, ["reviews", "prices", "contact"])


def own_term_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms on three tenths of a language's documents that the documents of our source lack."""
    docs = read_table(spark, sf_dir, "documents")
    own = F.coalesce(F.col("source") == OWN_SOURCE, F.lit(False))
    # counted once, for all sources and for our own
    each = written(phrases.count_terms(docs.select(F.col("lang").alias("scope"), own.alias("own"), "text"), ["scope", "own"]), "terms")
    pages = docs.groupBy(F.col("lang").alias("scope")).agg(F.count(F.lit(1)).alias("pages"))
    shared = each.groupBy("scope", "term").agg(F.sum("docs").alias("n")).join(pages, "scope").select("scope", "term", (F.col("n") / F.col("pages")).alias("share"))
    return briefs.missing_terms(shared, each.where("own").select("scope", "term"), 0.3).select("scope", "term", "place")


def template_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = read_table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("ordinal"), F.col("p_name").alias("seed"))
    return briefs.template_questions(seeds, ["what is {}", "how much does {} cost", "best {} compared"])


def best_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return rows.select("conv_id", "turn", briefs.best_excerpt(F.col("text"), T.keyword_terms(F.col("text"))).alias("excerpt"))


def plan_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    known = lambda m, e: F.when(k % e != 0, (k * m % 11) / F.lit(10.0))
    target = briefs.target_words(F.when(k % 3 != 0, (k * 37 % 3000).cast("double")), k * 13 % 2000)
    c = {"action": F.when(k % 2 == 0, "create").otherwise("rewrite"), "words": k * 13 % 2000, "target_words": target, "faq": known(3, 4), "facts": known(5, 3), "sources": known(7, 5), "author": known(9, 2), "fresh": known(2, 3), "compare": known(4, 4), "links": known(6, 5)}
    return read_table(spark, sf_dir, "documents").select("doc_id", target.alias("target"), F.array_join(briefs.baseline_steps(c), ",").alias("steps"))


def labels_and_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "part")
    typed = F.concat(F.lit(" "), "p_name", F.lit(";;"), "p_name", F.lit(",x"))
    return rows.select(
        "p_partkey", briefs.brand_label(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".example"))).alias("label"), F.array_join(briefs.tokens(typed), "|").alias("tokens"),
        briefs.extract_json(F.concat(F.lit("see {x "), F.to_json(F.struct("p_size", "p_name")), F.lit("} end"))).alias("json"), briefs.fit_title(F.concat("p_type", F.lit(" | "), F.repeat("p_name", 6))).alias("title"),
    )


def citation_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    cites = _citations(spark, sf_dir).select("answer_id", "ordinal", F.concat(F.lit("https://www."), "domain", F.lit(".example/p"), (F.col("ordinal") % 2).cast("string")).alias("url"))
    raw = cites.withColumn("kind", F.lit("cited")).unionByName(cites.withColumn("url", F.regexp_replace("url", "p1$", "p2")).withColumn("kind", F.lit("consulted")))
    return collect.collect_citations(raw, 3)


def winner_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cites = _citations(spark, sf_dir).withColumn("page", F.concat("domain", F.lit("/p"), (F.col("ordinal") % 2).cast("string")))
    lost = _answers(spark, sf_dir).join(cites.where("own").select("answer_id"), "answer_id", "left_anti")
    return collect.winners(cites, lost)


def skips_by_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("answer_id")
    pick = F.array(*[F.lit(x) for x in ("thin", "stale", "no_facts")])
    rows = _answers(spark, sf_dir).select((F.col("conv_id") % 9).alias("question_id"), "engine", k.alias("ordinal"), F.array_distinct(F.array(F.get(pick, (k % 3).cast("int")), F.get(pick, (k % 2).cast("int")))).alias("reasons"), F.when(k % 4 != 0, (k % 10) / F.lit(10.0)).alias("score"))
    return collect.group_skips(rows)


def google_rank_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = serp_results(spark, sf_dir).withColumn("url", F.replace("url", F.lit("#"), F.lit("-")))
    pages = results.select("url", F.col("keyword").alias("phrase"), (F.col("position") * -1).alias("importance"), F.col("key").alias("ordinal"))
    return collect.rank_lookup(pages, results.select(F.col("keyword").alias("phrase"), F.concat("url", F.lit("/?q")).alias("url"), "position"), 10)


QUERIES = {
    f.__name__: f
    for f in (
        title_patterns, title_words, schema_type_pages, trust_element_shares, own_term_gaps, template_questions, best_excerpts, plan_details, labels_and_forms, citation_collection, winner_pages, skips_by_question, google_rank_lookup,
    )
}

from .answers import _A, _CITE  # noqa: E402
from .text import _KW, _M  # noqa: E402

_K = lambda m, e: f"coalesce(CASE WHEN doc_id % {e} <> 0 THEN doc_id * {m} % 11 / 10.0::DOUBLE END, 0)"
_STEPS = [("doc_id % 2 = 0", "create_page"), ("doc_id % 2 <> 0", "answer_first"), ("doc_id * 13 % 2000 < target", "extend")] + [(f"{_K(m, e)} < 0.5", n) for m, e, n in ((3, 4, "add_faq"), (5, 3, "add_facts"), (7, 5, "cite_sources"), (9, 2, "name_author"), (2, 3, "update"), (4, 4, "add_table"), (6, 5, "link"))]

ORACLE_SQL = {
    "title_patterns": _M + f"""WITH t AS (SELECT p_brand AS scope, p_name || ' ' || p_type AS title, string_split(p_name, ' ')[1] AS keyword FROM part), k AS (SELECT *, {_KW.format('keyword')} AS kw, lr_terms(title) AS tt FROM t)
SELECT scope, count(*) AS pages, floor((sum(length(title)) * 2 + count(*)) / (2 * count(*)))::BIGINT AS mean_length, floor((count(*) FILTER (len(kw) > 0 AND tt[1 : len(kw)] = kw) * 2000 + count(*)) / (2 * count(*))) / 1000.0::DOUBLE AS starts FROM k GROUP BY scope""",
    "title_words": _M + """WITH t AS (SELECT p_brand AS scope, lr_words(p_name || ' ' || p_type) AS w, lr_words(string_split(p_name, ' ')[1]) AS k FROM part),
e AS (SELECT scope, unnest(list_distinct([x FOR x IN w IF length(x) >= 4 AND NOT list_contains(k, x)])) AS word FROM t), c AS (SELECT scope, word, count(*) AS pages FROM e GROUP BY ALL HAVING count(*) >= 2)
SELECT scope, word, pages, row_number() OVER (PARTITION BY scope ORDER BY pages DESC, word)::INT AS place FROM c QUALIFY place <= 6""",
    "schema_type_pages": """WITH e AS (SELECT p_brand AS scope, unnest(list_distinct([p_type, 'T' || (p_size % 7)])) AS type FROM part), c AS (SELECT scope, type, count(*) AS pages FROM e GROUP BY ALL)
SELECT scope, type, pages FROM c QUALIFY row_number() OVER (PARTITION BY scope ORDER BY pages DESC, type) <= 3""",
    "trust_element_shares": """WITH e AS (SELECT p_brand AS scope, 'reviews' AS element, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey * 3 % 11 / 10.0::DOUBLE END AS p FROM part UNION ALL SELECT p_brand, 'prices', CASE WHEN p_partkey % 3 <> 0 THEN p_partkey * 5 % 11 / 10.0::DOUBLE END FROM part
UNION ALL SELECT p_brand, 'contact', CASE WHEN p_partkey % 5 <> 0 THEN p_partkey * 7 % 11 / 10.0::DOUBLE END FROM part)
SELECT scope, element, count(*) AS pages, floor((count(*) FILTER (p >= 0.6) * 2000 + count(*)) / (2 * count(*))) / 1000.0::DOUBLE AS share FROM e WHERE p IS NOT NULL GROUP BY scope, element""",
    "own_term_gaps": _M + f"""WITH e AS (SELECT lang AS scope, source, doc_id, unnest(list_distinct(lr_terms(text))) AS term FROM documents), p AS (SELECT lang AS scope, count(*) AS pages FROM documents GROUP BY lang),
s AS (SELECT scope, term, count(*) / any_value(pages)::DOUBLE AS share FROM e JOIN p USING (scope) GROUP BY scope, term), o AS (SELECT DISTINCT scope, term FROM e WHERE source = '{OWN_SOURCE}')
SELECT scope, term, row_number() OVER (PARTITION BY scope ORDER BY share DESC, term)::INT AS place FROM s WHERE share >= 0.3 AND NOT EXISTS (SELECT 1 FROM o WHERE o.scope = s.scope AND o.term = s.term) QUALIFY place <= 8""",
    "template_questions": "SELECT (p_partkey * 3 + i)::BIGINT AS ordinal, replace(t, '{}', p_name) AS text FROM part, (VALUES (0, 'what is {}'), (1, 'how much does {} cost'), (2, 'best {} compared')) v(i, t)",
    "plan_details": f"""WITH t AS (SELECT doc_id, (floor(greatest(coalesce(CASE WHEN doc_id % 3 <> 0 THEN (doc_id * 37 % 3000)::DOUBLE END, 0), (doc_id * 13 % 2000) * 1.5::DOUBLE, 600) / 100 + 0.5) * 100)::BIGINT AS target FROM documents)
SELECT doc_id, target, array_to_string([x FOR x IN [{', '.join(f"CASE WHEN {r} THEN '{n}' END" for r, n in _STEPS)}] IF x IS NOT NULL], ',') AS steps FROM t""",
    "winner_pages": f"""WITH {_A}, {_CITE}, p AS (SELECT *, domain || '/p' || (ordinal % 2) AS page FROM c), l AS (SELECT answer_id FROM a WHERE answer_id NOT IN (SELECT answer_id FROM c WHERE own)),
n AS (SELECT engine, page, count(DISTINCT answer_id) AS n FROM p WHERE NOT own AND answer_id IN (SELECT answer_id FROM l) GROUP BY ALL), b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY engine ORDER BY n DESC, page) <= 3)
SELECT page, sum(n)::BIGINT AS answers, count(*) AS engines, row_number() OVER (ORDER BY sum(n) DESC, page)::INT AS place FROM b GROUP BY page QUALIFY place <= 10""",
    "google_rank_lookup": f"""WITH {RESULTS_SQL}, p AS (SELECT url, keyword AS phrase, position, key FROM serp), f AS (SELECT phrase FROM p GROUP BY phrase ORDER BY min((position, key)), phrase LIMIT 10)
SELECT replace(p.url, '#', '-') AS url, p.phrase, min(s.position) AS rank FROM p JOIN f USING (phrase) LEFT JOIN serp s ON s.keyword = p.phrase AND s.url = p.url GROUP BY ALL""",
}

ORACLE_SQL |= {
    "skips_by_question": f"""WITH {_A}, s AS (SELECT conv_id % 9 AS question_id, engine, answer_id AS ordinal, list_distinct([['thin', 'stale', 'no_facts'][answer_id % 3 + 1], ['thin', 'stale', 'no_facts'][answer_id % 2 + 1]]) AS reasons, CASE WHEN answer_id % 4 <> 0 THEN answer_id % 10 / 10.0::DOUBLE END AS score FROM a),
o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY question_id, engine ORDER BY ordinal) = 1), e AS (SELECT question_id, reason, count(*) AS n FROM (SELECT question_id, unnest(reasons) AS reason FROM o) GROUP BY ALL),
l AS (SELECT question_id, string_agg(reason, ',' ORDER BY n DESC, reason) AS reasons FROM e GROUP BY question_id)
SELECT question_id, count(*) AS engines, any_value(l.reasons) AS reasons, min(coalesce(score, -1)) AS score FROM o JOIN l USING (question_id) GROUP BY question_id""",
    "citation_collection": f"""WITH {_A}, {_CITE}, r AS (SELECT answer_id, ordinal, 'https://www.' || domain || '.example/p' || (ordinal % 2) AS url, domain || '.example' AS domain, 'cited' AS kind FROM c
UNION ALL SELECT answer_id, ordinal, regexp_replace('https://www.' || domain || '.example/p' || (ordinal % 2), 'p1$', 'p2'), domain || '.example', 'consulted' FROM c),
o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY answer_id, kind, domain, url ORDER BY ordinal) = 1), k AS (SELECT * FROM o WHERE kind = 'cited' OR NOT EXISTS (SELECT 1 FROM o x WHERE x.kind = 'cited' AND x.answer_id = o.answer_id AND x.domain = o.domain AND x.url = o.url))
SELECT answer_id, kind, row_number() OVER (PARTITION BY answer_id, kind ORDER BY ordinal)::INT AS place, url, domain FROM k QUALIFY place <= 3""",
}

ORACLE_SQL |= {
    "best_excerpts": _M + f"""WITH s AS (SELECT conv_id, turn, {_KW.format('text')} AS kw, [x FOR x IN regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+') IF length(x) > 20] AS s FROM conversations WHERE role = 'assistant'),
n AS (SELECT conv_id, turn, s, [len(list_intersect(kw, lr_terms(x))) FOR x IN s] AS n FROM s), p AS (SELECT *, list_position(n, list_max(n)) AS pos FROM n)
SELECT conv_id, turn, CASE WHEN len(s) > 0 THEN left(array_to_string(s[pos : pos + 3], ' '), 600) END AS excerpt FROM p""",
    "labels_and_forms": r"""WITH p AS (SELECT p_partkey, p_name, p_type, p_size, regexp_split_to_array(trim(p_name || ';;' || p_name || ',x'), '[\s,;]+') AS t, p_type || ' | ' || repeat(p_name, 6) AS title FROM part)
SELECT p_partkey, array_to_string([upper(left(w, 1)) || lower(substr(w, 2)) FOR w IN string_split(p_name, ' ')], ' ') AS label, array_to_string([t[i] FOR i IN range(1, len(t) + 1) IF t[i] <> '' AND list_position(t, t[i]) = i], '|') AS tokens,
'{"p_size":' || p_size || ',"p_name":"' || p_name || '"}' AS json, CASE WHEN length(title) <= 62 THEN title ELSE p_type END AS title FROM p""",
}
