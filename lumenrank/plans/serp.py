"""Queries over result lists, made from lineitem, part and supplier.

keyword = p_brand, domain = s_name, position = rank by revenue in cents. Types and shares that
the tables lack are whole-number formulas of the supplier's key, the same in the SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import weights as W
from ..functions.numbers import r3, ratio3
from ..operators import serp
from ..sources.tables import read_table

OWN, TRACKED = "Supplier#000000007", ["Supplier#000000003", "nowhere.example"]


def serp_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(keyword, domain, key, position, url)."""
    lines = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    parts = read_table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("keyword"))
    sums = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("keyword", F.col("l_suppkey").alias("key")).agg(F.sum("cents").alias("cents"))
    named = sums.join(read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("domain")), "key")
    rank = F.row_number().over(Window.partitionBy("keyword").orderBy(F.desc("cents"), "key"))
    return named.select("keyword", "domain", "key", rank.alias("position")).withColumn("url", F.concat(F.lit("https://"), "domain", F.lit("/"), "keyword"))


RESULTS_SQL = """serp AS (
  SELECT keyword, s_name AS domain, key, row_number() OVER (PARTITION BY keyword ORDER BY cents DESC, key)::INT AS position, 'https://' || s_name || '/' || keyword AS url
  FROM (SELECT p_brand AS keyword, l_suppkey AS key, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) JOIN supplier ON key = s_suppkey)"""

_TYPES_SQL = "[" + ", ".join(f"'{t}'" for t in W.PAGE_TYPES) + "]"
_FIT = lambda v: "[" + ", ".join(f"{x}::DOUBLE" for x in v) + "]"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = serp_results(spark, sf_dir)
    dominance = serp.topical_dominance(results)
    types = F.array(*[F.lit(t) for t in W.PAGE_TYPES])
    intent = F.when(F.ascii(F.substring("keyword", -1, 1)) % 2 == 0, "informational").otherwise("commercial")
    rows = results.join(dominance.select("domain", "dominance"), "domain", "left").select(
        "keyword", "domain", "position", "key",
        F.get(types, (F.col("key") % 10).cast("int")).alias("page_type"), intent.alias("intent"),
        F.when(F.col("key") % 7 != 0, (F.col("key") * 3 % 11) / F.lit(10.0)).alias("dedicated"),
        ((F.col("key") * 5 + F.col("position")) % 5 / F.lit(4.0)).alias("title"),
        F.when(F.col("key") % 3 == 0, (F.col("key") % 9) / F.lit(8.0)).alias("depth"), "dominance",
    )
    rows = rows.withColumn("fit", F.when(F.col("key") % 13 != 0, serp.type_fit(F.col("page_type"), F.col("intent"))))
    return rows.withColumn("strength", serp.result_strength(*(F.col(c) for c in ("fit", "dedicated", "title", "dominance", "depth"))))


OBSERVATIONS_SQL = f"""{RESULTS_SQL},
dominance AS (SELECT domain, count(*) AS lists, floor((count(*) * 2000 + n) / (2 * n)) / 1000.0::DOUBLE AS dominance
  FROM (SELECT DISTINCT keyword, domain FROM serp WHERE position <= 5), (SELECT count(DISTINCT keyword) AS n FROM serp) WHERE n >= 3 GROUP BY domain, n),
typed AS (SELECT s.*, ({_TYPES_SQL})[key % 10 + 1] AS page_type, CASE WHEN ascii(right(keyword, 1)) % 2 = 0 THEN 'informational' ELSE 'commercial' END AS intent,
  CASE WHEN key % 7 <> 0 THEN (key * 3 % 11) / 10.0::DOUBLE END AS dedicated, ((key * 5 + position) % 5) / 4.0::DOUBLE AS title,
  CASE WHEN key % 3 = 0 THEN (key % 9) / 8.0::DOUBLE END AS depth, d.dominance FROM serp s LEFT JOIN dominance d USING (domain)),
fitted AS (SELECT *, CASE WHEN key % 13 <> 0 THEN CASE WHEN intent = 'informational' THEN ({_FIT(W.FIT_INFORMATIONAL)})[key % 10 + 1] ELSE ({_FIT(W.FIT_COMMERCIAL)})[key % 10 + 1] END END AS fit FROM typed),
obs AS (SELECT *, CASE WHEN depth IS NULL THEN base / (0.3::DOUBLE + 0.25::DOUBLE + 0.2::DOUBLE + 0.1::DOUBLE) ELSE (base + depth * 0.15::DOUBLE) / (0.3::DOUBLE + 0.25::DOUBLE + 0.2::DOUBLE + 0.1::DOUBLE + 0.15::DOUBLE) END AS strength
  FROM (SELECT *, coalesce(fit, 0.5::DOUBLE) * 0.3::DOUBLE + coalesce(dedicated, 0.5::DOUBLE) * 0.25::DOUBLE + title * 0.2::DOUBLE + coalesce(dominance, 0::DOUBLE) * 0.1::DOUBLE AS base FROM fitted))"""


def serp_first_per_domain_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = serp_results(spark, sf_dir).withColumn("domain", F.concat(F.lit("site"), (F.col("key") % 40).cast("string")))
    return serp.select_targets(grouped.select("keyword", "domain", "position", "url"), "site7", 10, 12).select("keyword", "domain", "position", "url", "rank")


def serp_topical_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serp.topical_dominance(serp_results(spark, sf_dir))


def serp_result_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select("keyword", "domain", "position", "page_type", "fit", r3(F.col("strength")).alias("strength"))


def serp_weakness_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serp.assess(observations(spark, sf_dir))


def intent_vote_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).withColumn("weight", serp.by_position(W.POSITION_WEIGHTS, W.POSITION_REST, F.col("position")) * (500 + F.col("key") % 5 * 100))
    return serp.vote_shares(rows, ["keyword"], "page_type", "weight", "position")


def share_of_voice_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serp.competitor_profiles(serp_results(spark, sf_dir), OWN, TRACKED)


def vulnerable_keywords_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serp.vulnerable_keywords(observations(spark, sf_dir))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderdate")
    customers = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = read_table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("domain"))
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    counted = rows.groupBy(F.col("o_orderpriority").alias("report"), "domain").agg(
        F.count(F.lit(1)).alias("keywords"), F.min(F.col("o_custkey") % 50 + 1).alias("best"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("created_at")
    )
    total = F.sum("keywords").over(Window.partitionBy("report"))
    return counted.withColumn("share", F.floor((F.col("keywords") * 2000 + total) / (total * 2)).cast("long"))


def competitor_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serp.competitor_overview(_reports(spark, sf_dir), ["FRANCE", "nowhere.example"])


def untracked_competitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serp.untracked_suggestions(competitor_overview(spark, sf_dir)).select("domain", "reports", "avg_share")


def own_rank_and_peer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed figures of each keyword: own rank, lists' size, share of depth known."""
    obs = observations(spark, sf_dir)
    return obs.groupBy("keyword").agg(
        F.min(F.when(F.col("domain") == OWN, F.col("position"))).alias("own_rank"),
        F.count(F.lit(1)).alias("results"),
        ratio3(F.count("depth"), F.count(F.lit(1))).alias("depth_known"),
        F.min_by("page_type", "position").alias("first_type"),
    )


_MEAN = lambda x: f"sum(w * ({x})) / nullif(sum(CASE WHEN ({x}) IS NOT NULL THEN w END), 0)"
_R3 = lambda x: f"floor(({x}) * 1000 + 0.5) / 1000.0::DOUBLE"
_POSITION_SQL = "coalesce((" + str(W.POSITION_WEIGHTS) + ")[position], 100)"
_CTR_SQL = "coalesce((" + str(W.CTR_CURVE) + ")[position], 5)"
_OVERVIEW_SQL = """counted AS (SELECT o_orderpriority AS report, n_name AS domain, count(*) AS keywords, min(o_custkey % 50 + 1) AS best, strftime(max(o_orderdate), '%Y-%m-%d') AS created_at
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
shared AS (SELECT *, floor((keywords * 2000 + sum(keywords) OVER p) / (2 * sum(keywords) OVER p))::BIGINT AS share FROM counted WINDOW p AS (PARTITION BY report)),
seen AS (SELECT domain, count(DISTINCT report) AS reports, sum(keywords) AS keywords, floor((sum(share) * 2000 + count(*) * 1000) / (count(*) * 2000)) / 1000.0::DOUBLE AS avg_share, min(best) AS best, max(created_at) AS last_seen FROM shared GROUP BY domain),
tracked AS (SELECT unnest(['FRANCE', 'nowhere.example']) AS domain),
overview AS (SELECT domain, t.domain IS NOT NULL AS tracked, coalesce(reports, 0)::BIGINT AS reports, coalesce(keywords, 0)::BIGINT AS keywords, avg_share, best, last_seen FROM seen FULL JOIN tracked t USING (domain))"""

QUERIES = {
    f.__name__: f
    for f in (
        serp_first_per_domain_targets, serp_topical_dominance, serp_result_strength, serp_weakness_assessment, intent_vote_shares, share_of_voice_profiles,
        vulnerable_keywords_topk, competitor_overview, untracked_competitors, own_rank_and_peer_stats,
    )
}

ORACLE_SQL = {
    "serp_first_per_domain_targets": f"""WITH {RESULTS_SQL},
g AS (SELECT keyword, 'site' || (key % 40) AS domain, position, url FROM serp),
firsts AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY keyword, domain ORDER BY position) = 1),
deep AS (SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY position) <= 10),
kept AS (SELECT * FROM deep UNION SELECT * FROM g WHERE domain = 'site7'),
cut AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY (domain <> 'site7')::INT, position, url) <= 12)
SELECT keyword, domain, position, url, row_number() OVER (PARTITION BY keyword ORDER BY position, url)::INT AS rank FROM cut""",
    "serp_topical_dominance": f"""WITH {RESULTS_SQL}
SELECT domain, count(*) AS lists, floor((count(*) * 2000 + n) / (2 * n)) / 1000.0::DOUBLE AS dominance
FROM (SELECT DISTINCT keyword, domain FROM serp WHERE position <= 5), (SELECT count(DISTINCT keyword) AS n FROM serp) WHERE n >= 3 GROUP BY domain, n""",
    "serp_result_strength": f"WITH {OBSERVATIONS_SQL} SELECT keyword, domain, position, page_type, fit, {_R3('strength')} AS strength FROM obs",
    "serp_weakness_assessment": f"""WITH {OBSERVATIONS_SQL}, weighed AS (SELECT *, {_POSITION_SQL}::DOUBLE AS w FROM obs),
agg AS (SELECT keyword, {_MEAN('1 - strength')} AS raw, {_R3(_MEAN('1 - coalesce(fit, 0.5::DOUBLE)'))} AS type_mismatch, {_R3(_MEAN('1 - coalesce(dedicated, 0.5::DOUBLE)'))} AS not_dedicated,
  {_R3(_MEAN('1 - title'))} AS title_gap, {_R3(_MEAN('coalesce(dominance, 0::DOUBLE)'))} AS dominance, {_R3(_MEAN('1 - depth'))} AS thin_content FROM weighed GROUP BY keyword)
SELECT * EXCLUDE (raw), CASE WHEN raw >= 0.5 THEN 'easy' WHEN raw >= 0.38 THEN 'medium' ELSE 'hard' END AS difficulty, {_R3('raw')} AS weakness FROM agg""",
    "intent_vote_shares": f"""WITH {OBSERVATIONS_SQL},
summed AS (SELECT keyword, page_type, sum({_POSITION_SQL} * (500 + key % 5 * 100))::BIGINT AS w, min(position) AS o FROM obs GROUP BY ALL)
SELECT keyword, page_type, floor((w * 2000 + sum(w) OVER p) / (2 * sum(w) OVER p)) / 1000.0::DOUBLE AS share,
  first_value(page_type) OVER (PARTITION BY keyword ORDER BY w DESC, o) AS dominant FROM summed WINDOW p AS (PARTITION BY keyword)""",
    "share_of_voice_profiles": f"""WITH {RESULTS_SQL},
rows_ AS (SELECT domain, keyword, position, {_CTR_SQL} AS ctr, row_number() OVER (PARTITION BY domain, keyword ORDER BY position) = 1 AS f FROM serp),
seen AS (SELECT domain, count(*) FILTER (f) AS keywords, count(*) FILTER (f AND position <= 3) AS top3, count(*) FILTER (f AND position <= 10) AS top10, min(position) AS best,
  floor((sum(position) * 2000 + count(*)) / (2 * count(*))) / 1000.0::DOUBLE AS avg_position, sum(ctr)::BIGINT AS ctr FROM rows_ GROUP BY domain),
named AS (SELECT unnest(['{OWN}', '{TRACKED[0]}', '{TRACKED[1]}']) AS domain),
both_ AS (SELECT domain, CASE WHEN domain = '{OWN}' THEN 'own' WHEN domain IN ('{TRACKED[0]}', '{TRACKED[1]}') THEN 'tracked' ELSE 'discovered' END AS role,
  coalesce(keywords, 0) AS keywords, coalesce(top3, 0) AS top3, coalesce(top10, 0) AS top10, best, avg_position, coalesce(ctr, 0) AS ctr, (SELECT sum(ctr) FROM seen) AS t FROM seen FULL JOIN named USING (domain)),
ranked AS (SELECT *, row_number() OVER (ORDER BY CASE role WHEN 'own' THEN 0 WHEN 'tracked' THEN 1 ELSE 2 END, ctr DESC, domain)::INT AS place FROM both_)
SELECT domain, role, keywords, top3, top10, best, avg_position, floor((ctr * 2000 + t) / (2 * t)) / 1000.0::DOUBLE AS share_of_voice, place FROM ranked WHERE place <= 12""",
    "vulnerable_keywords_topk": f"""WITH {OBSERVATIONS_SQL}
SELECT domain, keyword, position, {_R3('strength')} AS strength, CASE WHEN fit < 0.5 THEN 'wrong_type' WHEN dedicated < 0.5 THEN 'not_dedicated' WHEN title < 0.5 THEN 'title_gap' ELSE 'shallow' END AS reason,
  row_number() OVER (PARTITION BY domain ORDER BY position DESC, keyword)::INT AS place FROM obs WHERE position >= 3 AND strength < 0.5 QUALIFY place <= 5""",
    "competitor_overview": f"WITH {_OVERVIEW_SQL} SELECT * FROM overview",
    "untracked_competitors": f"WITH {_OVERVIEW_SQL} SELECT domain, reports, avg_share FROM overview WHERE NOT tracked ORDER BY reports DESC, avg_share DESC NULLS LAST, domain LIMIT 25",
    "own_rank_and_peer_stats": f"""WITH {OBSERVATIONS_SQL} SELECT keyword, min(position) FILTER (domain = '{OWN}') AS own_rank, count(*) AS results,
  floor((count(depth) * 2000 + count(*)) / (2 * count(*))) / 1000.0::DOUBLE AS depth_known, arg_min(page_type, position) AS first_type FROM obs GROUP BY keyword""",
}
