"""Queries with state, panels with facets, exports, judgments and stored reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import briefs, html, judgments, panels
from ..sources import cache, reports, results_json
from ..sources.shared import new_folder
from ..sources.tables import read_table
from ..streaming import limits


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events")


def sliding_failure_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = _events(spark, sf_dir).where("event_type = 'error'")
    return limits.sliding_count(errors, "user_id", 86_400, 2).select("event_id", "user_id", "n", "retry_after")


def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.failure_streaks(_events(spark, sf_dir), "user_id", F.col("event_type").isin("error", "click"), 3)


def budget_running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("value") * 100).cast("long")
    return limits.within_budget(_events(spark, sf_dir), "user_id", cents, 50_000).select("event_id", "user_id", "spent")


def last_state_per_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.last_state(_events(spark, sf_dir), "user_id")


def cache_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("value"), (F.unix_seconds(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000).alias("expires_at"))
    return limits.unexpired(rows, F.lit(1_705_000_000_000))


#: When the cache's puts are, and how long a namespace's entries hold, in milliseconds.
_NOW, _LIVES = 1_700_000_000_000, {"view": 5 * 3_600_000, "click": 90 * 60_000, "error": 0}


def cache_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events put into a cache in three rounds an hour apart, each over the one before; what has expired goes; then every key of every
    kind is asked for, and fifty of those not held may be bought."""
    held = cache.Cache(spark, new_folder(spark, "cache"), 9_000_000, _LIVES)
    rows = _events(spark, sf_dir).select("event_id", F.col("event_type").alias("namespace"), (F.col("user_id") % 500).cast("string").alias("key"), F.col("event_id").cast("string").alias("value"))
    for k in range(3):
        held.put(rows.where(F.col("event_id") % 3 == k).where(F.length("key") != k + 1), _NOW + k * 3_600_000, F.col("event_id"))
        if k == 1:
            held.prune(_NOW + 2 * 3_600_000)
    asked = rows.groupBy("namespace", "key").agg(F.min("event_id").alias("first"))
    return held.within_budget(asked, _NOW + 3 * 3_600_000, [F.col("first")], 50).select("namespace", "key", "value", "outcome")


def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("event_type", (F.from_json("props", "k int")["k"] % 5).alias("k")).agg(F.count(F.lit(1)).alias("events"))


def structured_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly counts by a stream over the events' files as they are now."""
    schema = _events(spark, sf_dir).schema
    folder = f"{sf_dir}/events*.parquet"
    out = limits.run_available(spark, folder, schema, lambda s: limits.windowed_counts(s))
    return out.select(F.unix_seconds("window.start").alias("start"), "event_type", "n", "cents")


def sliding_limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sliding limit by a stream over the events' files as they are now."""
    schema = _events(spark, sf_dir).schema
    out = limits.run_available(spark, f"{sf_dir}/events*.parquet", schema, lambda s: limits.sliding_limit_stream(s.where("event_type = 'error'"), "user_id", 86_400, 2, "400 days"), "append")
    return out.select("event_id", F.col("key").alias("user_id"), "n", "retry_after")


def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each user by a stream that keeps it between batches."""
    out = limits.run_available(spark, f"{sf_dir}/events*.parquet", _events(spark, sf_dir).schema, limits.progress_stream, "update")
    return out.groupBy("user_id").agg(F.max_by("last_event", "batch").alias("last_event"), F.max_by("events", "batch").alias("events"))


def known_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps ticked off that a plan has, each once."""
    k = F.col("p_partkey")
    done = F.transform(F.array(k % 5, k % 3, k % 5, k % 7), lambda i: F.concat(F.lit("c"), i.cast("string")))
    return read_table(spark, sf_dir, "part").select("p_partkey", F.array_join(briefs.known_steps(done, F.array(*[F.lit(f"c{i}") for i in range(4)])), ",").alias("steps"))


def domain_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """International host names in ASCII."""
    names = F.get(F.array(F.lit("пример.example"), F.lit("müller.example"), F.lit("plain.example"), F.lit("a..b")), (F.col("p_partkey") % 4).cast("int"))
    return read_table(spark, sf_dir, "part").groupBy(names.alias("name"), U.to_ascii(names).alias("ascii")).agg(F.count(F.lit(1)).alias("rows"))


def decoded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages from bytes in the character set that their header or their first bytes name."""
    k = F.col("page_id")
    word = F.when(k % 2 == 0, F.unhex(F.lit("F6E5EDE0"))).otherwise(F.encode(F.lit("цена"), "UTF-8"))
    rows = read_table(spark, sf_dir, "pages").select("page_id", word.alias("body"), F.when(k % 2 == 0, "text/html; charset=windows-1251").otherwise("text/html").alias("content_type"))
    return html.decode_pages(rows).groupBy("html").agg(F.count(F.lit(1)).alias("pages"))


def settings_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of one row, and a patch that defines some of them."""
    now = spark.createDataFrame([("bg", 20, "own.example")], "market string, depth int, domain string")
    return reports.update_settings(now, spark.createDataFrame([(None, 30)], "market string, depth int"))


def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each facet under the filters of the others."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus", (F.col("o_custkey") % 3).cast("string").alias("kind"))
    return panels.facets(orders, {"o_orderpriority": ["1-URGENT", "2-HIGH"], "o_orderstatus": ["F", "O"], "kind": ["1"]})


def panel_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list filtered and sorted with nulls where the panel wants them."""
    rows = read_table(spark, sf_dir, "documents").join(read_table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "source", "quality", F.when(F.col("n_chars") > 300, F.col("n_chars")).alias("volume"))
    return panels.numbered(rows.where(F.contains("source", F.lit("1"))), [F.desc_nulls_last("volume"), F.asc_nulls_first("quality"), F.col("doc_id")], 50).select("doc_id", "volume", "quality", "place")


def judgment_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distributions judged for each label: choice with runner-up and confidence, score, yes or no."""
    k = F.col("doc_id")
    probs = F.create_map(F.lit("a"), (k * 7 % 11).cast("double"), F.lit("b"), (k * 5 % 7).cast("double"), F.lit("c"), (k % 3).cast("double"))
    rows = read_table(spark, sf_dir, "labels").select("doc_id", judgments.normalised(probs, ["a", "b", "c"]).alias("probs"))
    levels = F.array(*[F.try_element_at("probs", F.lit(x)) for x in ("a", "b", "c")])
    made = rows.select("doc_id", judgments.choice(F.col("probs"), ["a", "b", "c"]).alias("c"), levels.alias("levels"))
    return made.select("doc_id", "c.value", "c.p", "c.runner_up", "c.confidence", judgments.score_of(F.col("levels")).alias("score"), judgments.score_confidence(F.col("levels")).alias("score_confidence"))


def merged_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    one, two = (F.create_map(F.lit("a"), (k * m % 11 / F.lit(10.0)), F.lit("b"), 1 - k * m % 11 / F.lit(10.0)) for m in (7, 3))
    c = judgments.choice(judgments.merge(one, two), ["a", "b"])
    return read_table(spark, sf_dir, "labels").select("doc_id", c["value"].alias("value"), c["p"].alias("p"))


def csv_safe_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 3 == 0, "=").when(F.col("p_partkey") % 3 == 1, 'a"b,').otherwise("x;"), "p_name").alias("name"), "p_size")
    return reports.csv_lines(rows)


def markdown_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "part").select("p_name", "p_type", F.concat(F.lit("*"), "p_brand", F.lit("_")).alias("brand"))
    return reports.markdown_table(rows, [F.col("p_name"), F.col("p_type"), F.col("brand")], 30)


def report_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"), F.col("o_orderpriority").alias("keyword"))
    return reports.list_reports(rows).limit(100)


def tracked_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "supplier").select(F.col("s_name").alias("domain"), F.col("s_suppkey").cast("long").alias("added_at"))
    more = read_table(spark, sf_dir, "supplier").select(F.concat("s_name", F.when(F.col("s_suppkey") % 2 == 0, "x").otherwise("")).alias("domain"), (F.col("s_suppkey") + 1000).cast("long").alias("added_at"))
    return reports.remove_competitor(reports.add_competitor(rows, more), "Supplier#000000002")


def result_json_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw answers of both search interfaces, made from parts, read to one table of results."""
    part = read_table(spark, sf_dir, "part").select(F.col("p_brand").alias("keyword"), "p_partkey", F.concat(F.lit("https://www.site"), (F.col("p_partkey") % 9).cast("string"), F.lit(".co.uk/"), F.col("p_size").cast("string")).alias("link"), F.col("p_name").alias("title"))
    item = F.struct(F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("int")).alias("position"), "link", "title", F.lit(" a  b ").alias("snippet"))
    listed = part.groupBy("keyword").agg(F.sort_array(F.collect_list(F.struct("p_partkey", item.alias("i")))).alias("x"))
    flat = listed.select("keyword", F.to_json(F.struct(F.transform("x", lambda x: x["i"]).alias("organic"))).alias("json"))
    task = F.struct(F.lit("organic").alias("type"), F.col("p_partkey").cast("int").alias("rank_group"), F.col("link").alias("url"), "title", F.lit("d").alias("description"))
    tasks = part.groupBy("keyword").agg(F.sort_array(F.collect_list(F.struct("p_partkey", task.alias("i")))).alias("x")).select(
        "keyword", F.to_json(F.struct(F.array(F.struct(F.lit(20000).alias("status_code"), F.array(F.struct(F.transform("x", lambda x: x["i"]).alias("items"))).alias("result"))).alias("tasks"))).alias("json")
    )
    both = results_json.flat_results(flat).withColumn("via", F.lit("flat")).unionByName(results_json.task_results(tasks).withColumn("via", F.lit("tasks")))
    return both.groupBy("via", "keyword").agg(F.count(F.lit(1)).alias("results"), F.count_distinct("domain").alias("domains"), F.min("position").alias("first"), F.max("snippet").alias("snippet"))


def audit_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of counts and means, and whether the run is whole."""
    rows = read_table(spark, sf_dir, "documents").join(read_table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.agg(
        F.count(F.lit(1)).alias("pages"), F.count("quality").alias("judged"), F.count_if(F.col("quality") == 1).alias("good"), F.count_distinct("source").alias("sources"), F.bool_or(F.col("quality").isNull()).alias("partial"),
        F.when(F.count("toxic") == F.count(F.lit(1)), F.sum("toxic")).alias("cost"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        sliding_failure_limit, sliding_limit_stream, failure_streaks, budget_running_total, last_state_per_job, cache_expiry, cache_rounds, event_properties, structured_stream_windows, job_progress, known_steps, domain_forms, decoded_pages, settings_patch, facet_counts, panel_sort, judgment_parsing, merged_twins, csv_safe_export,
        markdown_export, report_index, tracked_registry, result_json_sources, audit_figures,
    )
}

_CELL = lambda c: f"""CASE WHEN regexp_matches({c}, '[",;\n\r]') THEN '"' || replace({c}, '"', '""') || '"' ELSE {c} END"""

ORACLE_SQL = {
    "sliding_failure_limit": """WITH e AS (SELECT *, epoch_us(ts) AS t FROM events WHERE event_type = 'error')
SELECT event_id, user_id, count(*) OVER w AS n, CASE WHEN count(*) OVER w >= 2 THEN ceil((min(t) OVER w + 86400000000 - t) / 1000000.0::DOUBLE)::BIGINT END AS retry_after FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)""",
    "failure_streaks": """WITH m AS (SELECT user_id, event_type IN ('error', 'click') AS f, sum(CASE WHEN event_type IN ('error', 'click') THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ok FROM events),
r AS (SELECT user_id, ok, count(*) AS n FROM m WHERE f GROUP BY ALL) SELECT user_id, max(n) AS longest, count(*) FILTER (n >= 3) AS trips FROM r GROUP BY user_id""",
    "budget_running_total": "SELECT event_id, user_id, sum(round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM events QUALIFY spent <= 50000",
    "last_state_per_job": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS events FROM events GROUP BY user_id",
    "cache_expiry": "WITH e AS (SELECT user_id AS key, event_id AS value, floor(epoch(ts))::BIGINT * 1000 + event_id % 1000 AS expires_at FROM events) SELECT key, arg_max(value, expires_at) AS value, max(expires_at) AS expires_at FROM e WHERE expires_at > 1705000000000 GROUP BY key",
    "event_properties": "SELECT event_type, (json_extract(props, '$.k')::INT % 5)::INT AS k, count(*) AS events FROM events GROUP BY ALL",
    "structured_stream_windows": "SELECT floor(epoch(date_trunc('hour', ts)))::BIGINT AS start, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY ALL",
    "facet_counts": """WITH o AS (SELECT o_orderpriority, o_orderstatus, (o_custkey % 3)::VARCHAR AS kind FROM orders)
SELECT 'o_orderpriority' AS facet, o_orderpriority AS value, count(*) AS n FROM o WHERE o_orderstatus IN ('F', 'O') AND kind = '1' GROUP BY ALL UNION ALL
SELECT 'o_orderstatus', o_orderstatus, count(*) FROM o WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND kind = '1' GROUP BY ALL UNION ALL
SELECT 'kind', kind, count(*) FROM o WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus IN ('F', 'O') GROUP BY ALL""",
    "panel_sort": """SELECT doc_id, CASE WHEN n_chars > 300 THEN n_chars END AS volume, quality, row_number() OVER (ORDER BY CASE WHEN n_chars > 300 THEN n_chars END DESC NULLS LAST, quality ASC NULLS FIRST, doc_id)::INT AS place
FROM documents LEFT JOIN labels USING (doc_id) WHERE contains(source, '1') QUALIFY place <= 50""",
    "csv_safe_export": f"""WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '=' WHEN 1 THEN 'a"b,' ELSE 'x;' END || p_name AS name, p_size FROM part), q AS (SELECT p_partkey, CASE WHEN regexp_matches(name, '^[=+\\-@\t\r]') THEN '''' || name ELSE name END AS name, p_size FROM p)
SELECT p_partkey || ',' || {_CELL('name')} || ',' || p_size AS line FROM q""",
    "report_index": "SELECT o_orderkey AS id, o_orderstatus AS kind, strftime(o_orderdate, '%Y-%m-%d') AS created_at, o_orderpriority AS keyword FROM orders ORDER BY created_at DESC, id LIMIT 100",
    "audit_figures": "SELECT count(*) AS pages, count(quality) AS judged, count(*) FILTER (quality = 1) AS good, count(DISTINCT source) AS sources, bool_or(quality IS NULL) AS partial, CASE WHEN count(toxic) = count(*) THEN sum(toxic)::BIGINT END AS cost FROM documents LEFT JOIN labels USING (doc_id)",
}

_J = """j AS (SELECT doc_id, (doc_id * 7 % 11)::DOUBLE AS a, (doc_id * 5 % 7)::DOUBLE AS b, (doc_id % 3)::DOUBLE AS c FROM labels),
n AS (SELECT doc_id, CASE WHEN a + b + c > 0 THEN [a / (a + b + c), b / (a + b + c), c / (a + b + c)] ELSE [1.0::DOUBLE / 3, 1.0::DOUBLE / 3, 1.0::DOUBLE / 3] END AS p FROM j),
r AS (SELECT doc_id, p, list_sort([(-p[1], 0, 'a'), (-p[2], 1, 'b'), (-p[3], 2, 'c')]) AS o, list_position(p, list_max(p)) - 1 AS mode FROM n)"""
ORACLE_SQL |= {
    "judgment_parsing": f"""WITH {_J} SELECT doc_id, o[1][3] AS value, floor(-o[1][1] * 1000 + 0.5) / 1000.0::DOUBLE AS p, o[2][3] AS runner_up, floor(greatest(0, least(1, (-o[1][1] - 1.0::DOUBLE / 3) / (1 - 1.0::DOUBLE / 3))) * 1000 + 0.5) / 1000.0::DOUBLE AS confidence,
floor((p[2] + p[3] * 2) / 2 * 1000 + 0.5) / 1000.0::DOUBLE AS score, floor(greatest(0, least(1, 1 - (p[1] * abs(0 - mode) + p[2] * abs(1 - mode) + p[3] * abs(2 - mode)) / (2.0::DOUBLE / 3))) * 1000 + 0.5) / 1000.0::DOUBLE AS score_confidence FROM r""",
    "merged_twins": """WITH m AS (SELECT doc_id, (doc_id * 7 % 11 / 10.0::DOUBLE + doc_id * 3 % 11 / 10.0::DOUBLE) / 2 AS a, ((1 - doc_id * 7 % 11 / 10.0::DOUBLE) + (1 - doc_id * 3 % 11 / 10.0::DOUBLE)) / 2 AS b FROM labels)
SELECT doc_id, CASE WHEN a >= b THEN 'a' ELSE 'b' END AS value, floor(greatest(a, b) * 1000 + 0.5) / 1000.0::DOUBLE AS p FROM m""",
    "tracked_registry": """WITH t AS (SELECT s_name AS domain, s_suppkey::BIGINT AS added_at FROM supplier), f AS (SELECT s_name || CASE WHEN s_suppkey % 2 = 0 THEN 'x' ELSE '' END AS domain, s_suppkey::BIGINT + 1000 AS added_at FROM supplier),
b AS (SELECT * FROM t UNION ALL SELECT * FROM f WHERE domain NOT IN (SELECT domain FROM t)), g AS (SELECT domain, min(added_at) AS added_at FROM b GROUP BY domain ORDER BY 2, 1 LIMIT 100)
SELECT domain, added_at FROM g WHERE domain <> 'Supplier#000000002'""",
    "markdown_export": r"""WITH r AS (SELECT p_name, p_type, '*' || p_brand || '_' AS brand FROM part ORDER BY p_name, p_type, 3 LIMIT 30), e AS (SELECT [regexp_replace(x, '([\\`*_{}\[\]()#+|<>!~-])', '\\\1', 'g') FOR x IN [p_name, p_type, brand]] AS c FROM r)
SELECT '| ' || array_to_string(c, ' | ') || ' |' AS line FROM e UNION ALL SELECT unnest(['| p_name | p_type | brand |', '| --- | --- | --- |'])""",
}
ORACLE_SQL |= {
    "job_progress": "SELECT user_id, max(event_id) AS last_event, count(*) AS events FROM events GROUP BY user_id",
    "known_steps": """WITH s AS (SELECT p_partkey, [p_partkey % 5, p_partkey % 3, p_partkey % 5, p_partkey % 7] AS d FROM part)
SELECT p_partkey, array_to_string([ 'c' || d[i] FOR i IN [1, 2, 3, 4] IF d[i] < 4 AND list_position(d, d[i]) = i], ',') AS steps FROM s""",
    "domain_forms": "SELECT ['пример.example', 'müller.example', 'plain.example', 'a..b'][p_partkey % 4 + 1] AS name, ['xn--e1afmkfd.example', 'xn--mller-kva.example', 'plain.example', NULL][p_partkey % 4 + 1] AS ascii, count(*) AS rows FROM part GROUP BY ALL",
    "decoded_pages": "SELECT 'цена' AS html, count(*) AS pages FROM pages",
    "settings_patch": "SELECT 'bg' AS market, 30 AS depth, 'own.example' AS domain",
}
ORACLE_SQL |= {
    "result_json_sources": """WITH p AS (SELECT p_brand AS keyword, p_partkey AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nth, p_partkey % 9 AS site, p_size FROM part),
r AS (SELECT 'flat' AS via, keyword, CASE WHEN k % 2 = 0 AND k > 0 THEN k ELSE nth END AS position, nth, site, p_size, 'a b' AS snippet FROM p UNION ALL SELECT 'tasks', keyword, CASE WHEN k > 0 THEN k ELSE nth END, nth, site, p_size, 'd' FROM p),
o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY via, keyword, site, p_size ORDER BY nth) = 1) SELECT via, keyword, count(*) AS results, count(DISTINCT site) AS domains, min(position)::INT AS first, max(snippet) AS snippet FROM o GROUP BY via, keyword""",
}

ORACLE_SQL["sliding_limit_stream"] = ORACLE_SQL["sliding_failure_limit"]

ORACLE_SQL["cache_rounds"] = """WITH r AS (SELECT event_id, event_type AS namespace, (user_id % 500)::VARCHAR AS key, event_id::VARCHAR AS value, event_id % 3 AS k FROM events),
p AS (SELECT namespace, key, k, arg_max(value, event_id) AS value, 1700000000000 + k * 3600000 + CASE namespace WHEN 'view' THEN 18000000 WHEN 'click' THEN 5400000 ELSE 9000000 END AS expires_at FROM r WHERE length(key) <> k + 1 AND namespace <> 'error' GROUP BY ALL),
n AS (SELECT namespace, key, arg_max(value, k) AS value, arg_max(expires_at, k) AS expires_at FROM p GROUP BY namespace, key), a AS (SELECT namespace, key, min(event_id) AS first FROM r GROUP BY namespace, key),
g AS (SELECT a.*, value FROM a LEFT JOIN n ON n.namespace = a.namespace AND n.key = a.key AND expires_at > 1700000000000 + 3 * 3600000),
b AS (SELECT namespace, key FROM g WHERE value IS NULL ORDER BY first, namespace, key LIMIT 50)
SELECT g.namespace, g.key, g.value, CASE WHEN g.value IS NOT NULL THEN 'hit' WHEN b.key IS NOT NULL THEN 'bought' ELSE 'over_budget' END AS outcome FROM g LEFT JOIN b ON b.namespace = g.namespace AND b.key = g.key"""
