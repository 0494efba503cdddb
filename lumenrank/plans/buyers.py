"""Queries over buyers' questions: gathered, screened, met with pages and answers; skips and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import weights as W
from ..operators import buyers, recovery
from ..sources.tables import read_table
from . import answers as _answers_plan
from .answers import _A, _CITE, ENGINES, _answers, _citations
from .keywords import SPACES
from .text import _KW, _M

COUNT = 24


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("ordinal", F.col("conv_id") * 1000 + F.col("turn"))


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return buyers.seeds(read_table(spark, sf_dir, "part").select(k.alias("ordinal"), ((k * 7) % 101 / F.lit(100.0)).alias("importance"), F.lower("p_name").alias("phrase")))


def question_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seeds(spark, sf_dir)


def _raw_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _asked(spark, sf_dir).withColumn("kind", F.get(F.array(F.lit("paa"), F.lit("related"), F.lit("suggest"), F.lit("llm")), (F.col("conv_id") % 4).cast("int")))
    searches = rows.where("kind <> 'llm'").select((F.col("turn") % 3).alias("seed"), "kind", "ordinal", "text")
    return buyers.collect_questions(searches, rows.where("kind = 'llm'").select("ordinal", "text"), _seeds(spark, sf_dir))


def collected_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that searches, the writer and templates bring, in order."""
    return _raw_questions(spark, sf_dir).select("text", "source", F.col("ord.part").alias("part"), F.col("ord.a").alias("a"), F.col("ord.b").alias("b"), F.col("ord.c").alias("c"))


def buyer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions of a report: deduplicated, screened by judgments, dealt over stages, with volumes."""
    one = buyers.dedupe_questions(_raw_questions(spark, sf_dir))
    n = F.length("key")
    stages = F.array(*[F.lit(s) for s in [*W.STAGES, "other"]])
    judged = one.where(n % 5 != 0).select("key", F.get(stages, (n % 7).cast("int")).alias("stage"), (n * 7 % 101 / F.lit(100.0)).alias("relevance"))
    balanced = buyers.balance_questions(buyers.screen_questions(one, judged), COUNT)
    volumes = one.select(F.concat(F.lit("  "), "text").alias("keyword"), F.when(F.length("text") % 2 == 0, F.length("text") * 10).alias("volume"))
    return buyers.with_volumes(balanced, volumes, None).select("place", "text", "source", "stage", "relevance", "volume")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers_plan.question_coverage(spark, sf_dir)


def question_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best page of each question by judged answers, what it amounts to and what to do next."""
    met = _candidates(spark, sf_dir)
    q = F.col("question_id")
    judged = met.where((q + F.col("place")) % 4 != 0).select("question_id", "url", ((q * 7 + F.col("place") * 13) % 101 / F.lit(100.0)).alias("answer"), ((q * 11 + F.col("place")) % 101 / F.lit(100.0)).alias("angle"))
    pages = met.select("url").distinct().withColumn("answer_first", F.col("url").cast("long") * 7 % 101 / F.lit(100.0))
    stages = F.array(*[F.lit(s) for s in W.STAGES])
    questions = _asked(spark, sf_dir).select(F.col("ordinal").alias("question_id"), F.get(stages, (F.col("conv_id") % 6).cast("int")).alias("stage"))
    return buyers.check_coverage(questions, met.select("question_id", "url", "overlap"), judged, pages)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _answers(spark, sf_dir).withColumn("question_id", F.col("conv_id"))
    own = _citations(spark, sf_dir).where("own").select("answer_id").distinct().withColumn("cited", F.lit(True))
    status = F.when(F.col("conv_id") % 11 == 0, "failed").when(F.col("cited"), "cited").when(F.col("answer_id") % 5 == 0, "named").otherwise("missing")
    return rows.join(own, "answer_id", "left").withColumn("status", status).drop("cited")


def question_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = buyers.question_citations(_records(spark, sf_dir), _citations(spark, sf_dir))
    return out.select("question_id", F.array_join("ai_cites", ",").alias("ai_cites"), F.array_join("cited_by", ",").alias("cited_by"))


def brief_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select((F.col("conv_id") % 20).alias("scope"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"), "role", "text")
    headings = rows.where("role = 'assistant'").withColumn("text", F.substring_index("text", "\n", 1))
    return buyers.merge_questions(rows.where("role = 'user'").drop("role"), headings.drop("role"))


def _skip_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    records = _records(spark, sf_dir)
    lost = records.where("status = 'missing'").select(F.col("answer_id").alias("ordinal"), "answer_id", "engine", "question_id")
    n, k = F.col("question_id"), F.col("i")
    ids = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("question_id")).distinct()
    questions = ids.select("question_id", F.concat(F.lit("which garden tool number "), (n % 15).cast("string"), F.lit(" fits"), F.repeat(F.lit(" very"), (n % 4).cast("int")), F.lit(" well?")).alias("text"))
    match = n * 7 % 101 / F.lit(100.0)
    coverage = ids.select("question_id", F.concat(F.lit("https://site.example/p"), (n % 9).cast("string")).alias("best_page"), match.alias("match"), F.when(n % 5 != 0, n * 11 % 101 / F.lit(100.0)).alias("angle"), buyers.verdict_of(match).alias("verdict"))
    known = lambda m, e: F.when(k % e != 0, k * m % 101 / F.lit(100.0))
    pages = spark.range(9).select(F.concat(F.lit("https://site.example/p"), F.col("id").cast("string")).alias("url"), F.col("id").alias("i")).select(
        "url", (k * 170 + 100).alias("words"), (k * 4).alias("age"), known(29, 3).alias("fresh"), known(19, 4).alias("answer"), known(23, 5).alias("facts"), known(31, 6).alias("author"), known(37, 2).alias("sources")
    )
    others = _citations(spark, sf_dir).where("not own")
    first = others.groupBy("answer_id").agg(F.min_by("domain", "ordinal").alias("winner_domain")).withColumn("winner_words", F.when(F.col("answer_id") % 4 != 0, F.col("answer_id") * 17 % 2500))
    return lost, questions, coverage, pages, first


def skip_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each lost answer with our page, who is cited instead, why, and what to do."""
    out = recovery.assemble_skips(*_skip_inputs(spark, sf_dir), None)
    return out.select("answer_id", "question_id", "our_url", "exists", "winner_domain", F.array_join("reasons", ",").alias("reasons"), "action")


def _plan_rows(spark: SparkSession, skips: DataFrame) -> DataFrame:
    n = F.regexp_extract("text", r"number (\d+)", 1).cast("int")
    clusters = skips.where("action = 'create' or our_url is null").select("text", (n % 6).alias("cluster")).distinct()
    titles = spark.range(0, 9, 2).select(F.concat(F.lit("https://site.example/p"), F.col("id").cast("string")).alias("our_url"), F.concat(F.lit("Page number "), F.col("id").cast("string")).alias("title"))
    out = recovery.build_plans(skips, clusters, titles, ENGINES)
    return out.select("place", "key", "kind", "url", "title", "lost", "n_questions", "winners", "path", F.array_join("questions", "|").alias("questions"), F.array_join("engines", ",").alias("engines"), F.array_join("reasons", ",").alias("reasons"), "priority")


def plan_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans over all lost answers, with titles, paths, reasons by count and engines in order."""
    lost, questions, coverage, pages, first = _skip_inputs(spark, sf_dir)
    return _plan_rows(spark, recovery.assemble_skips(lost, questions, coverage, pages, first, None))


def plan_without_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans for the questions the site does not answer, where no assistant was asked."""
    _, questions, coverage, pages, _ = _skip_inputs(spark, sf_dir)
    return _plan_rows(spark, recovery.pseudo_skips(questions, coverage, pages, ENGINES[0]))


def winner_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cited instead of ours, with their score and why they are cited."""
    k = F.col("doc_id")
    known = lambda m, e: F.when(k % e != 0, k * m % 101 / F.lit(100.0))
    c = {"answer": known(7, 5), "facts": known(11, 3), "sources": known(13, 4), "author": known(17, 6), "faq": known(19, 7), "fresh": known(23, 4), "compare": known(29, 8), "links": known(31, 9)}
    c |= {"age": F.when(k % 3 != 0, k % 30), "external": k % 12, "words": F.when(k % 10 != 0, k * 13 % 3000), "types": F.slice(F.array(F.lit("Service"), F.lit("FAQPage"), F.lit("Product")), F.lit(1), (k % 4).cast("int"))}
    out = recovery.winner_pages(read_table(spark, sf_dir, "documents").select("doc_id"), c)
    return out.select("doc_id", "score10", F.array_join("why", "; ").alias("why"), F.col("radar.entity").alias("entity"), F.col("radar.sources").alias("radar_sources"))


QUERIES = {
    f.__name__: f
    for f in (question_seeds, collected_questions, buyer_questions, question_verdicts, question_citations, brief_questions, skip_assembly, plan_board, plan_without_answers, winner_details)
}

_SEEDS = """seeds AS (SELECT phrase, min((-importance, ordinal)) AS o FROM (SELECT p_partkey AS ordinal, p_partkey * 7 % 101 / 100.0::DOUBLE AS importance, lower(p_name) AS phrase FROM part) WHERE len(string_split(phrase, ' ')) <= 5 GROUP BY phrase ORDER BY o, phrase LIMIT 3),
chosen AS (SELECT (row_number() OVER (ORDER BY o, phrase) - 1)::INT AS seed, phrase FROM seeds)"""
_CLEAN = rf"trim(regexp_replace(regexp_replace(text, '{SPACES}', ' ', 'g'), '^[\s\-–•\d.)]+', ''))"
_ASK = f"(SELECT upper(left(x, 1)) || substr(x, 2) FROM (SELECT CASE WHEN ends_with({_CLEAN}, '?') THEN {_CLEAN} ELSE {_CLEAN} || '?' END AS x))"
_TEMPLATES = ", ".join(f"({i}, '{t}')" for i, t in enumerate(buyers.TEMPLATES))
_RAW = f"""{_SEEDS}, u AS (SELECT conv_id, turn, conv_id * 1000 + turn AS ordinal, ['paa', 'related', 'suggest', 'llm'][conv_id % 4 + 1] AS kind, text FROM conversations WHERE role = 'user'),
raw AS (SELECT {_ASK} AS text, kind AS source, 0 AS part, (turn % 3)::BIGINT AS a, CASE kind WHEN 'paa' THEN 0 WHEN 'related' THEN 1 ELSE 2 END::BIGINT AS b, ordinal AS c FROM u WHERE kind <> 'llm' AND turn % 3 IN (SELECT seed FROM chosen) AND (kind = 'paa' OR lr_asks(text))
UNION ALL SELECT {_ASK}, 'llm', 1, ordinal, 0, 0 FROM u WHERE kind = 'llm'
UNION ALL SELECT replace(t, '{{}}', phrase), 'template', 2, seed, i, 0 FROM chosen, (VALUES {_TEMPLATES}) v(i, t))"""
_STAGES = "['discover', 'compare', 'price', 'trust', 'howto', 'local']"
_RANK = "list_position(['llm', 'paa', 'suggest', 'related', 'template'], source) - 1"
_RECORDS = f"""{_A}, {_CITE}, recs AS (SELECT a.*, conv_id AS question_id, CASE WHEN conv_id % 11 = 0 THEN 'failed' WHEN answer_id IN (SELECT answer_id FROM c WHERE own) THEN 'cited' WHEN answer_id % 5 = 0 THEN 'named' ELSE 'missing' END AS status FROM a)"""
_IK = lambda m, e: f"CASE WHEN i % {e} <> 0 THEN i * {m} % 101 / 100.0::DOUBLE END"
_SKIPS = f"""ids AS (SELECT DISTINCT conv_id AS question_id FROM conversations), qs AS (SELECT question_id, 'which garden tool number ' || (question_id % 15) || ' fits' || repeat(' very', (question_id % 4)::INT) || ' well?' AS text FROM ids),
cov AS (SELECT *, CASE WHEN match < 0.3 THEN 'no_page' WHEN match < 0.62 THEN 'weak' ELSE 'answered' END AS verdict FROM (SELECT question_id, 'https://site.example/p' || (question_id % 9) AS best_page, question_id * 7 % 101 / 100.0::DOUBLE AS match, CASE WHEN question_id % 5 <> 0 THEN question_id * 11 % 101 / 100.0::DOUBLE END AS angle FROM ids)),
pg AS (SELECT 'https://site.example/p' || i AS our_url, i * 170 + 100 AS words, i * 4 AS age, {_IK(29, 3)} AS fresh, {_IK(19, 4)} AS answer, {_IK(23, 5)} AS facts, {_IK(31, 6)} AS author, {_IK(37, 2)} AS sources, true AS has FROM range(9) t(i)),
met AS (SELECT l.*, q.text, v.match, v.angle, p.our_url, p.words, p.age, p.fresh, p.answer, p.facts, p.author, p.sources, coalesce(p.has, false) AS has FROM lost l JOIN qs q USING (question_id) LEFT JOIN cov v USING (question_id) LEFT JOIN pg p ON v.verdict <> 'no_page' AND v.best_page = p.our_url),
why AS (SELECT *, list_sort([x FOR x IN [CASE WHEN angle < 0.4 THEN (-(1.2::DOUBLE - angle), 0, 'wrong_angle') END, CASE WHEN answer < 0.45 THEN (-(1 - answer), 1, 'no_answer') END,
  CASE WHEN words < 350 OR words < winner_words * 0.6::DOUBLE THEN (-coalesce(1 - words / nullif(winner_words, 0)::DOUBLE, 0.7::DOUBLE), 2, 'too_thin') END, CASE WHEN facts < 0.4 THEN (-(1 - facts), 3, 'no_facts') END,
  CASE WHEN author < 0.35 THEN (-(1 - author), 4, 'no_author') END, CASE WHEN age >= 18 OR fresh < 0.4 THEN (-coalesce(1 - fresh, 0.6::DOUBLE), 5, 'stale') END] IF x IS NOT NULL]) AS made,
  list_min([x FOR x IN [CASE WHEN answer IS NOT NULL THEN (answer, 0, 'no_answer') END, CASE WHEN facts IS NOT NULL THEN (facts, 1, 'no_facts') END, CASE WHEN sources IS NOT NULL THEN (sources, 2, 'weak_trust') END] IF x IS NOT NULL]) AS weakest FROM met),
named AS (SELECT *, CASE WHEN NOT has THEN ['no_page'] WHEN len(made) > 0 THEN [x[3] FOR x IN made[1:4]] ELSE [coalesce(weakest[3], 'too_thin')] END AS reasons FROM why),
skips AS (SELECT *, CASE WHEN list_contains(reasons, 'no_page') OR list_contains(reasons, 'wrong_angle') AND coalesce(match, 0) < 0.45 THEN 'create' ELSE 'rewrite' END AS action FROM named)"""
_FIRST = "fc AS (SELECT answer_id, arg_min(domain, ordinal) AS winner_domain, CASE WHEN answer_id % 4 <> 0 THEN answer_id * 17 % 2500 END AS winner_words FROM c WHERE NOT own GROUP BY answer_id)"
_LOST = f"{_RECORDS}, {_FIRST}, lost AS (SELECT r.answer_id AS ordinal, r.answer_id, r.engine, r.question_id, winner_domain, winner_words FROM recs r LEFT JOIN fc USING (answer_id) WHERE status = 'missing')"
_SLUG = "regexp_replace(left(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+', ''), 50), '-+$', '')"
_BOARD = f"""keyed AS (SELECT *, CASE WHEN action = 'create' OR our_url IS NULL THEN 'create' ELSE 'rewrite' END AS kind, CASE WHEN action = 'create' OR our_url IS NULL THEN 'new:' || (regexp_extract(text, 'number (\\d+)', 1)::INT % 6) ELSE 'page:' || our_url END AS key FROM skips),
q1 AS (SELECT key, text, min(ordinal) AS ordinal FROM keyed GROUP BY ALL), qn AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ordinal) AS nth FROM q1),
ql AS (SELECT key, string_agg(text, '|' ORDER BY nth) FILTER (nth <= 8) AS questions, arg_min(text, (length(text), ordinal)) AS shortest, count(*) AS n_questions FROM qn GROUP BY key),
rl AS (SELECT key, string_agg(reason, ',' ORDER BY n DESC, reason) AS reasons FROM (SELECT key, reason, count(*) AS n FROM (SELECT key, unnest(reasons) AS reason FROM keyed) GROUP BY ALL) GROUP BY key),
main AS (SELECT key, kind, count(*) AS lost, list(DISTINCT engine) AS e, min(our_url) AS url, count(DISTINCT winner_domain) AS winners FROM keyed GROUP BY key, kind), total AS (SELECT greatest(count(*), 1) AS t FROM skips),
titled AS (SELECT main.*, questions, reasons, n_questions, t, left(CASE WHEN kind = 'rewrite' THEN coalesce(CASE WHEN regexp_extract(url, '(\\d+)$', 1)::INT % 2 = 0 THEN 'Page number ' || regexp_extract(url, '(\\d+)$', 1) END, url)
  ELSE upper(left(shortest, 1)) || regexp_replace(substr(shortest, 2), '[?\\s]+$', '') END, 160) AS title FROM main JOIN ql USING (key) LEFT JOIN rl USING (key), total)
SELECT row_number() OVER (ORDER BY lost DESC, n_questions DESC, key)::INT AS place, key, kind, url, title, lost, n_questions, winners, CASE WHEN kind = 'create' THEN '/' || {_SLUG.format('title')} END AS path, questions,
array_to_string([x FOR x IN ['alpha', 'beta', 'gamma'] IF list_contains(e, x)], ',') AS engines, reasons, floor((lost * 2000 + t) / (2 * t)) / 1000.0::DOUBLE AS priority FROM titled QUALIFY place <= 12"""
_DK = lambda m, e: f"CASE WHEN doc_id % {e} <> 0 THEN doc_id * {m} % 101 / 100.0::DOUBLE END"

from .audit import _W, _WEIGHTED  # noqa: E402

ORACLE_SQL = {
    "question_seeds": f"WITH {_SEEDS} SELECT * FROM chosen",
    "collected_questions": _M + f"WITH {_RAW} SELECT * FROM raw",
    "buyer_questions": _M + f"""WITH {_RAW}, k AS (SELECT *, array_to_string(list_sort({_KW.format('text')}), ' ') AS key, (part, a, b, c) AS ord FROM raw WHERE length(text) BETWEEN 10 AND 200),
one AS (SELECT key, arg_min(text, ({_RANK}, ord)) AS text, arg_min(source, ({_RANK}, ord)) AS source, min(ord) AS ord FROM k WHERE key <> '' GROUP BY key),
j AS (SELECT *, CASE WHEN length(key) % 5 <> 0 AND length(key) % 7 < 6 THEN {_STAGES}[length(key) % 7 + 1] ELSE 'discover' END AS stage, CASE WHEN length(key) % 5 <> 0 THEN floor(length(key) * 7 % 101 / 100.0::DOUBLE * 1000 + 0.5) / 1000.0::DOUBLE ELSE 0.5::DOUBLE END AS relevance FROM one),
r AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY {_RANK}, relevance DESC, ord) AS n FROM j WHERE relevance >= 0.5), p AS (SELECT *, row_number() OVER (ORDER BY n, list_position({_STAGES}, stage))::INT AS place FROM r QUALIFY place <= {COUNT}),
v AS (SELECT lower(trim(text)) AS vk, max(length(text) * 10)::INT AS volume FROM one WHERE length(text) % 2 = 0 GROUP BY 1)
SELECT place, text, source, stage, relevance, volume FROM p LEFT JOIN v ON lower(trim(text)) = vk""",
    "question_verdicts": _M + f"""WITH met AS ({_answers_plan.ORACLE_SQL['question_coverage'].removeprefix(_M)}),
j AS (SELECT *, CASE WHEN (question_id + place) % 4 <> 0 THEN (question_id * 7 + place * 13) % 101 / 100.0::DOUBLE END AS answer, CASE WHEN (question_id + place) % 4 <> 0 THEN (question_id * 11 + place) % 101 / 100.0::DOUBLE END AS angle, url::BIGINT * 7 % 101 / 100.0::DOUBLE AS af FROM met),
b AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY answer DESC NULLS LAST, overlap DESC, url) = 1),
q AS (SELECT conv_id * 1000 + turn AS question_id, {_STAGES}[conv_id % 6 + 1] AS stage FROM conversations WHERE role = 'user'),
v AS (SELECT q.question_id, stage, url, af, CASE WHEN url IS NULL THEN 0.0::DOUBLE ELSE floor(answer * 1000 + 0.5) / 1000.0::DOUBLE END AS match, CASE WHEN answer IS NOT NULL THEN floor(angle * 1000 + 0.5) / 1000.0::DOUBLE END AS angle, url IS NULL OR answer IS NOT NULL AS judged,
  CASE WHEN url IS NULL THEN 'no_page' WHEN answer IS NOT NULL THEN CASE WHEN answer < 0.3 THEN 'no_page' WHEN answer < 0.62 THEN 'weak' ELSE 'answered' END WHEN overlap >= 0.5 THEN 'weak' ELSE 'no_page' END AS verdict FROM q LEFT JOIN b USING (question_id))
SELECT question_id, CASE WHEN verdict <> 'no_page' THEN url END AS best_page, match, angle, verdict, CASE WHEN verdict = 'answered' THEN 'none' WHEN verdict = 'no_page' THEN CASE stage WHEN 'compare' THEN 'write_versus' WHEN 'local' THEN 'add_local' ELSE 'write_guide' END
  WHEN angle < 0.4 THEN CASE stage WHEN 'compare' THEN 'write_versus' ELSE 'write_guide' END WHEN af < 0.5 THEN 'answer_at_top' WHEN stage = 'trust' THEN 'add_proof' WHEN stage = 'price' THEN 'add_prices' WHEN stage = 'local' THEN 'add_local' ELSE 'answer_at_top' END AS next_step, judged FROM v""",
    "question_citations": f"""WITH {_RECORDS}, came AS (SELECT * FROM recs WHERE status <> 'failed'), n AS (SELECT question_id, domain, count(DISTINCT answer_id) AS n FROM came JOIN c USING (answer_id) WHERE NOT own GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, domain) AS place FROM n QUALIFY place <= 4), l AS (SELECT question_id, string_agg(domain, ',' ORDER BY place) AS ai_cites FROM t GROUP BY question_id)
SELECT question_id, coalesce(any_value(ai_cites), '') AS ai_cites, array_to_string(list_sort(coalesce(list(DISTINCT engine) FILTER (status <> 'missing'), [])), ',') AS cited_by FROM came LEFT JOIN l USING (question_id) GROUP BY question_id""",
    "brief_questions": _M + f"""WITH r AS (SELECT conv_id % 20 AS scope, conv_id * 1000 + turn AS ordinal, 0 AS part, text FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id % 20, conv_id * 1000 + turn, 1, string_split(text, chr(10))[1] FROM conversations WHERE role = 'assistant' AND lr_asks(string_split(text, chr(10))[1])),
k AS (SELECT *, array_to_string(list_sort({_KW.format('text')}), ' ') AS key FROM r), o AS (SELECT * FROM k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY scope, key ORDER BY part, ordinal) = 1)
SELECT scope, text, row_number() OVER (PARTITION BY scope ORDER BY part, ordinal)::INT AS place FROM o QUALIFY place <= 12""",
    "skip_assembly": f"WITH {_LOST}, {_SKIPS} SELECT answer_id, question_id, our_url, has AS exists, winner_domain, array_to_string(reasons, ',') AS reasons, action FROM skips",
    "plan_board": f"WITH {_LOST}, {_SKIPS}, {_BOARD}",
    "plan_without_answers": f"WITH lost AS (SELECT DISTINCT conv_id AS ordinal, conv_id AS answer_id, 'alpha' AS engine, conv_id AS question_id, NULL::VARCHAR AS winner_domain, NULL::INT AS winner_words FROM conversations WHERE conv_id * 7 % 101 / 100.0::DOUBLE < 0.62), {_SKIPS}, {_BOARD}",
    "winner_details": f"""WITH d AS (SELECT doc_id, {_DK(7, 5)} AS answer, {_DK(11, 3)} AS facts, {_DK(13, 4)} AS sources, {_DK(17, 6)} AS author, {_DK(19, 7)} AS faq, {_DK(23, 4)} AS fresh, {_DK(29, 8)} AS compare, {_DK(31, 9)} AS links, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 30 END AS age,
  CASE WHEN doc_id % 10 <> 0 THEN doc_id * 13 % 3000 END AS words, (['Service', 'FAQPage', 'Product'])[1 : doc_id % 4] AS types FROM documents)
SELECT doc_id, coalesce(floor(CASE WHEN answer IS NOT NULL OR facts IS NOT NULL THEN {_WEIGHTED(list(_W.items()))} END * 100 + 0.5) / 10.0::DOUBLE, 0) AS score10,
CASE WHEN words IS NULL THEN '' ELSE array_to_string(([x FOR x IN [CASE WHEN answer >= 0.7 THEN 'answer first' END, CASE WHEN faq >= 0.8 THEN 'questions with markup' END, CASE WHEN compare >= 0.9 THEN 'comparison table' END, CASE WHEN fresh >= 0.9 AND age IS NOT NULL THEN 'updated ' || greatest(1, age) || ' months ago' END,
  CASE WHEN sources >= 0.6 THEN 'cites ' || (doc_id % 12) || ' sources' END, CASE WHEN facts >= 0.7 THEN 'many facts' END, CASE WHEN author >= 0.7 THEN 'author and company named' END, CASE WHEN words >= 1200 THEN 'about ' || (floor(words / 100.0::DOUBLE + 0.5) * 100)::BIGINT || ' words' END,
  CASE WHEN len(types) >= 2 THEN 'markup: ' || array_to_string(types, ', ') END] IF x IS NOT NULL])[1:6], '; ') END AS why, facts AS entity, sources AS radar_sources FROM d""",
}
