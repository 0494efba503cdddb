"""Queries over keyword candidates, questions and briefs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..functions import weights as W
from ..operators import opportunities as O
from ..operators import phrases, ranking
from ..sources.tables import read_table


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as screened keywords; shares are whole-number formulas of the key."""
    k = F.col("p_partkey")
    rows = read_table(spark, sf_dir, "part").select(
        F.concat_ws(" ", "p_name", k.cast("string")).alias("keyword"), k.alias("key"),
        ((k * 7) % 101 / F.lit(100.0)).alias("relevance"), ((k * 13) % 97 / F.lit(96.0)).alias("commercial"),
        F.when(k % 4 != 0, (k * 3) % 89 / F.lit(88.0)).alias("weakness"), F.when(k % 3 != 0, (F.col("p_size") * F.col("p_size") * 10).cast("long")).alias("volume"),
        (F.col("p_size") % 6).alias("terms"), (F.col("p_size") % 5 == 0).alias("local"), (k % 2 == 0).alias("modifier_only"),
        *[((k * m) % 11 / F.lit(10.0)).alias(c) for m, c in ((2, "mismatch"), (3, "not_dedicated"), (4, "title_gap"), (5, "thin"), (6, "dominance"))],
    )
    return rows.withColumn("difficulty", F.when(F.col("weakness") >= W.EASY_AT, "easy").when(F.col("weakness") >= W.MEDIUM_AT, "medium").when(F.col("weakness").isNotNull(), "hard"))


_CANDIDATES_SQL = """c AS (SELECT p_name || ' ' || p_partkey AS keyword, p_partkey AS key, p_partkey * 7 % 101 / 100.0::DOUBLE AS relevance, p_partkey * 13 % 97 / 96.0::DOUBLE AS commercial,
  CASE WHEN p_partkey % 4 <> 0 THEN p_partkey * 3 % 89 / 88.0::DOUBLE END AS weakness, CASE WHEN p_partkey % 3 <> 0 THEN (p_size * p_size * 10)::BIGINT END AS volume, p_size % 6 AS terms, p_size % 5 = 0 AS local, p_partkey % 2 = 0 AS modifier_only,
  p_partkey * 2 % 11 / 10.0::DOUBLE AS mismatch, p_partkey * 3 % 11 / 10.0::DOUBLE AS not_dedicated, p_partkey * 4 % 11 / 10.0::DOUBLE AS title_gap, p_partkey * 5 % 11 / 10.0::DOUBLE AS thin, p_partkey * 6 % 11 / 10.0::DOUBLE AS dominance FROM part),
d AS (SELECT *, CASE WHEN weakness >= 0.5 THEN 'easy' WHEN weakness >= 0.38 THEN 'medium' WHEN weakness IS NOT NULL THEN 'hard' END AS difficulty,
  least(1, CASE WHEN terms <= 1 THEN 0.2::DOUBLE WHEN terms = 2 THEN 0.45::DOUBLE WHEN terms = 3 THEN 0.7::DOUBLE WHEN terms = 4 THEN 0.9::DOUBLE ELSE 1 END + CASE WHEN local THEN 0.1::DOUBLE ELSE 0 END)::DOUBLE AS specific,
  CASE WHEN volume IS NOT NULL THEN least(1, log10(volume + 1) / 3.5::DOUBLE) END AS wanted FROM c),
e AS (SELECT *, relevance * (coalesce(weakness, 0.35::DOUBLE) * 0.5::DOUBLE + commercial * 0.2::DOUBLE + specific * 0.15::DOUBLE + coalesce(wanted, 0.4::DOUBLE) * 0.15::DOUBLE) * 100 AS raw FROM d),
f AS (SELECT *, floor(CASE WHEN weakness IS NULL THEN least(raw, 52) ELSE raw END * 10 + 0.5) / 10.0::DOUBLE AS score FROM e),
scored AS (SELECT *, CASE WHEN relevance < 0.5 THEN 'skip' WHEN difficulty = 'easy' AND score >= 52 THEN 'quick_win' WHEN score >= 42 THEN 'good' WHEN score >= 28 THEN 'hard' ELSE 'skip' END AS label FROM f)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir).withColumn("specific", O.specificity(F.col("terms"), F.col("local"))).withColumn("wanted", O.demand(F.col("volume")))
    rows = rows.withColumn("score", O.score(*(F.col(c) for c in ("relevance", "weakness", "commercial", "specific", "wanted"))))
    return rows.withColumn("label", O.label(F.col("relevance"), F.col("score"), F.col("difficulty")))


def opportunity_score_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("weakness", "mismatch", "not_dedicated", "title_gap", "thin", "dominance", "commercial", "volume", "specific")
    rows = _scored(spark, sf_dir).withColumn("reasons", F.array_join(O.reasons(*(F.col(c) for c in cols)), ","))
    return O.rank(rows.select("keyword", "score", "label", "reasons"))


def opportunity_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header figures: verified, quick wins, good ones, by label."""
    return _scored(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("keywords"), F.count("weakness").alias("verified"), F.max("score").alias("best"), F.count_if(F.col("local")).alias("local"))


def pick_with_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir).where(F.col("relevance") >= W.MIN_RELEVANCE)
    points = F.floor((F.col("relevance") * (F.lit(0.55) + F.col("commercial") * 0.45) + F.when(F.col("local"), 0.12).otherwise(0.0)) * 10000 + 0.5).cast("long")
    picked = ranking.pick_with_quota(rows.withColumn("points", points), [F.desc("points"), F.col("keyword")], F.col("modifier_only"), 0.6, 25)
    return picked.select("keyword", "points", "modifier_only", "place")


def round_robin_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by stage in turn: order priorities stand for stages."""
    rows = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("stage"), F.round(F.col("o_totalprice") * 100).cast("long").alias("relevance"))
    return ranking.round_robin(rows, "stage", F.col("stage"), [F.desc("relevance"), F.col("id")], 33).select("id", "stage", "place")


def ordered_union_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ideas of two sources merged by key: first spelling, all sources, first place."""
    part = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), F.col("p_type").alias("text"), F.lit("suggest").alias("source"))
    more = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), F.concat("p_brand", F.lit(" "), "p_type").alias("text"), F.lit("related").alias("source"))
    again = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), F.upper("p_type").alias("text"), F.lit("paa").alias("source"))
    both = ranking.ordered_union([part, more, again]).withColumn("text", T.squash(F.col("text")))
    merged = ranking.merge_by_key(both.withColumn("key", T.keyword_key(F.col("text"))), "key", "text", "source")
    return merged.orderBy("ord").limit(80).select("key", "text", F.array_join("sources", ",").alias("sources"), F.col("ord.part").alias("part"), F.col("ord.at").alias("nth"))


def question_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions deduplicated by key with the best source kept at the first place; stage and
    relevance from judgments where there are any."""
    asked = read_table(spark, sf_dir, "conversations").where("role = 'user'").select(
        F.col("conv_id"), T.squash(F.col("text")).alias("text"), (F.col("turn") % 5).cast("int").alias("rank"), (F.col("conv_id") * 100 + F.col("turn")).alias("ord")
    )
    keyed = asked.where("length(text) between 10 and 200").withColumn("key", T.keyword_key(F.col("text")))
    one = keyed.groupBy("key").agg(F.min_by(F.struct("text", "rank", "conv_id"), F.struct("rank", "ord")).alias("q"), F.min("ord").alias("ord"))
    judged = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    out = one.select("key", "q.text", "q.rank", "q.conv_id", "ord").join(judged, F.col("conv_id") == F.col("doc_id"), "left")
    relevance = F.when(F.col("quality").isNull(), 0.5).otherwise(F.col("quality") * 0.9)
    return out.withColumn("relevance", relevance).where("relevance >= 0.5").select("key", "text", "rank", "ord", "relevance")


def content_length_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length brackets by source: median of texts of 100 words or more, if there are three."""
    rows = read_table(spark, sf_dir, "documents").select("source", "lang", F.size(T.words(F.col("text"))).alias("words")).where("words >= 100")
    # a histogram first: what is ordered in a group has one row a length, not one a document
    counts = rows.groupBy("source", "lang", "words").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("source", "lang")
    upto = counts.withColumns({"upto": F.sum("n").over(group.orderBy("words")), "pages": F.sum("n").over(group)}).where("pages >= 3")
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("words")))
    last = F.col("pages") - 1
    stats = upto.groupBy("source", "lang", "pages").agg(
        ((at(F.floor(last / 2)) + at(F.ceil(last / 2))) / F.lit(2.0)).alias("median"), at(F.floor(last * 0.75 + 0.5)).alias("p75")
    )
    to50 = lambda x: (F.floor(x / 50 + 0.5) * 50).cast("long")
    return stats.select("source", "lang", "pages", "p75", to50(F.col("median") * 0.8).alias("least"), to50(F.col("median") * 1.15).alias("target"), to50(F.col("median") * 1.5).alias("most"))


def brief_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms to cover by language: on at least two fifths of the pages, the fifteen most common."""
    rows = phrases.count_terms(read_table(spark, sf_dir, "documents"), ["lang"])
    pages = read_table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("pages"))
    counted = rows.withColumnRenamed("docs", "n").join(pages, "lang")
    kept = counted.where(F.col("n") >= F.greatest(F.lit(2).cast("double"), F.ceil(F.col("pages") * 0.4)))
    return ranking.top_per(kept, ["lang"], [F.desc("n"), F.col("term")], 15, "place").select("lang", "term", "n", N.ratio3(F.col("n"), F.col("pages")).alias("share"), "place")


def peer_median_and_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").cast("long").alias("q"), "l_partkey")
    # a histogram first: the list that is sorted has one entry a value, not one a row
    counts = lines.groupBy("l_returnflag", "l_linestatus", "q").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("l_returnflag", "l_linestatus").orderBy("q")
    upto = counts.select("l_returnflag", "l_linestatus", "q", "n", F.sum("n").over(w).alias("upto"), F.sum("n").over(Window.partitionBy("l_returnflag", "l_linestatus")).alias("all"))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("q")))
    return upto.groupBy("l_returnflag", "l_linestatus").agg(
        ((at(F.floor((F.col("all") - 1) / 2)) + at(F.ceil((F.col("all") - 1) / 2))) / F.lit(2.0)).alias("median"), at(F.floor((F.col("all") - 1) * 0.75 + 0.5)).alias("p75"), F.max("all").alias("rows")
    )


QUERIES = {
    f.__name__: f
    for f in (
        opportunity_score_rank, opportunity_label_counts, pick_with_quota, round_robin_balance, ordered_union_dedupe, question_screening, content_length_advice, brief_terms, peer_median_and_nearest_rank,
    )
}

from .text import _KW, _M  # noqa: E402

_REASONS = [("mismatch >= 0.45", "weak_types"), ("not_dedicated >= 0.4", "not_dedicated"), ("title_gap >= 0.35", "title_gap"), ("thin >= 0.5", "thin"), ("dominance >= 0.5", "dominated"), ("weakness < 0.4", "strong_pages"), ("commercial >= 0.65", "commercial"), ("commercial <= 0.3", "informational"), ("volume IS NOT NULL", "volume"), ("specific >= 0.9", "specific")]

ORACLE_SQL = {
    "opportunity_score_rank": f"WITH {_CANDIDATES_SQL} SELECT keyword, score, label, array_to_string(([x FOR x IN [{', '.join(f'''CASE WHEN {r}::DOUBLE THEN '{n}' END''' if r[-1].isdigit() else f'''CASE WHEN {r} THEN '{n}' END''' for r, n in _REASONS)}] IF x IS NOT NULL])[1:6], ',') AS reasons FROM scored",
    "opportunity_label_counts": f"WITH {_CANDIDATES_SQL} SELECT label, count(*) AS keywords, count(weakness) AS verified, max(score) AS best, count(*) FILTER (local) AS local FROM scored GROUP BY label",
    "pick_with_quota": f"""WITH {_CANDIDATES_SQL}, p AS (SELECT keyword, floor((relevance * (0.55::DOUBLE + commercial * 0.45::DOUBLE) + CASE WHEN local THEN 0.12::DOUBLE ELSE 0 END) * 10000 + 0.5)::BIGINT AS points, modifier_only FROM c WHERE relevance >= 0.5),
q AS (SELECT *, row_number() OVER (PARTITION BY modifier_only ORDER BY points DESC, keyword) AS n FROM p),
r AS (SELECT keyword, points, modifier_only, row_number() OVER (ORDER BY points DESC, keyword)::INT AS place FROM q WHERE NOT modifier_only OR n <= 15) SELECT * FROM r WHERE place <= 25""",
    "round_robin_balance": """WITH a AS (SELECT o_orderkey AS id, o_orderpriority AS stage, row_number() OVER (PARTITION BY o_orderpriority ORDER BY round(o_totalprice * 100)::BIGINT DESC, o_orderkey) AS n FROM orders)
SELECT id, stage, row_number() OVER (ORDER BY n, stage)::INT AS place FROM a QUALIFY place <= 33""",
    "ordered_union_dedupe": _M + f"""WITH u AS (SELECT 0 AS part, p_partkey AS nth, p_type AS text, 'suggest' AS source FROM part UNION ALL SELECT 1, p_partkey, p_brand || ' ' || p_type, 'related' FROM part UNION ALL SELECT 2, p_partkey, upper(p_type), 'paa' FROM part),
k AS (SELECT *, array_to_string(list_sort({_KW.format('text')}), ' ') AS key FROM u)
SELECT key, arg_min(text, (part, nth)) AS text, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, min((part, nth))[1]::INT AS part, min((part, nth))[2]::BIGINT AS nth FROM k GROUP BY key ORDER BY part, nth LIMIT 80""",
    "content_length_advice": _M + """WITH w AS (SELECT source, lang, len(lr_words(text)) AS words FROM documents WHERE len(lr_words(text)) >= 100),
s AS (SELECT source, lang, count(*) AS pages, median(words)::DOUBLE AS m, list_sort(list(words))[floor((count(*) - 1) * 0.75 + 0.5)::INT + 1]::INT AS p75 FROM w GROUP BY ALL HAVING count(*) >= 3)
SELECT source, lang, pages, p75, (floor(m * 0.8::DOUBLE / 50 + 0.5) * 50)::BIGINT AS least, (floor(m * 1.15::DOUBLE / 50 + 0.5) * 50)::BIGINT AS target, (floor(m * 1.5::DOUBLE / 50 + 0.5) * 50)::BIGINT AS most FROM s""",
    "brief_terms": _M + """WITH t AS (SELECT lang, unnest(list_distinct(lr_terms(text))) AS term FROM documents), p AS (SELECT lang, count(*) AS pages FROM documents GROUP BY lang),
c AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL)
SELECT lang, term, n, floor((n * 2000 + pages) / (2 * pages)) / 1000.0::DOUBLE AS share, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term)::INT AS place FROM c JOIN p USING (lang) WHERE n >= greatest(2, ceil(pages * 0.4::DOUBLE)) QUALIFY place <= 15""",
    "peer_median_and_nearest_rank": """SELECT l_returnflag, l_linestatus, median(l_quantity::BIGINT)::DOUBLE AS median, list_sort(list(l_quantity::BIGINT))[floor((count(*) - 1) * 0.75 + 0.5)::INT + 1] AS p75, count(*) AS rows FROM lineitem GROUP BY ALL""",
}

SPACES = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
ORACLE_SQL |= {
    "question_screening": _M + rf"""WITH q AS (SELECT conv_id, trim(regexp_replace(text, '{SPACES}', ' ', 'g')) AS text, (turn % 5)::INT AS rank, conv_id * 100 + turn AS ord FROM conversations WHERE role = 'user'),
k AS (SELECT *, array_to_string(list_sort({_KW.format('text')}), ' ') AS key FROM q WHERE length(text) BETWEEN 10 AND 200),
o AS (SELECT key, arg_min(text, (rank, ord)) AS text, arg_min(rank, (rank, ord)) AS rank, arg_min(conv_id, (rank, ord)) AS conv_id, min(ord) AS ord FROM k GROUP BY key),
j AS (SELECT o.*, CASE WHEN quality IS NULL THEN 0.5::DOUBLE ELSE quality * 0.9::DOUBLE END AS relevance FROM o LEFT JOIN labels ON conv_id = doc_id) SELECT key, text, rank, ord, relevance FROM j WHERE relevance >= 0.5""",
}
