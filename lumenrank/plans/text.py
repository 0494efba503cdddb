"""Queries over texts: terms, keys, coverage, phrases, clusters, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import phrases
from ..sources.shared import spread
from ..sources.tables import read_table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "lang", "source", "text"))


def stem_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents have each term."""
    return phrases.count_terms(read_table(spark, sf_dir, "documents"), [])


def keyword_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read_table(spark, sf_dir, "part")
    return parts.select("p_partkey", T.keyword_key(F.col("p_name")).alias("key"), F.size(T.keyword_terms(F.col("p_type"))).alias("n_terms"))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of what a user says the turn after it covers, and whether that opens with it."""
    turns = read_table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", T.keyword_terms(F.col("text")).alias("kw"))
    said = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), T.terms(F.col("text")).alias("terms"))
    both = asked.join(said, ["conv_id", "turn"])
    share = T.coverage(F.col("kw"), F.col("terms"))
    return both.select(
        "conv_id", "turn", F.floor(share * 1000 + 0.5).alias("coverage_milli"), (share >= 0.999).alias("contains"), T.starts_with_keyword(F.col("terms"), F.col("kw")).alias("opens"),
        F.floor(T.jaccard(F.col("kw"), F.array_distinct("terms")) * 1000 + 0.5).alias("jaccard_milli"),
    )


def question_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations")
    n = F.size(T.words(F.col("text")))
    return rows.groupBy(T.looks_like_question(F.col("text")).alias("question"), T.length_bucket(n).alias("bucket")).agg(F.count(F.lit(1)).alias("turns"))


def text_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _docs(spark, sf_dir).select("doc", F.md5(T.squash(text)).alias("squashed"), F.md5(T.fold_spellings(text)).alias("folded"), T.clip(text, 80).alias("clipped"), T.file_slug(text).alias("slug"), F.md5(T.loose_latin(text)).alias("loose"))


def phrase_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(_docs(spark, sf_dir), least_pages=3)


def prune_subsumed_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.prune_subsumed(phrases.mine_phrases(_docs(spark, sf_dir), least_pages=3)).select("key", "n", "pages")


def cluster_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of documents as headings, clustered by source and language."""
    return phrases.cluster_headings(_headings(spark, sf_dir))


def _headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = F.concat_ws("/", "source", "lang")
    docs = read_table(spark, sf_dir, "documents")
    return spread(docs.select(scope.alias("scope"), F.col("doc_id").alias("ordinal"), F.col("doc_id").alias("doc"), F.substring_index("text", "\n", 1).alias("heading")))


def subtopics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What headings of a scope share, the commonest words of their language left out."""
    return phrases.subtopics(_headings(spark, sf_dir), T.keyword_terms(F.lit("the of and la de der die en")), 0.05)


def cluster_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users ask, on four sites by id."""
    rows = read_table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") % 4).alias("scope"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"), "text")
    return phrases.cluster_questions(rows)


def duplicate_values_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.duplicate_values(_docs(spark, sf_dir), "lang", F.col("text"), "same").select("doc", "lang", "same")


QUERIES = {f.__name__: f for f in (stem_terms, keyword_key, coverage, question_shapes, text_cleaning, phrase_document_frequency, prune_subsumed_phrases, cluster_headings, subtopics, cluster_questions, duplicate_values_window)}


def _cut_sql(w: str, suffixes: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN ends_with({w}, '{x}') AND length({w}) >= {len(x) + 3} THEN left({w}, length({w}) - {len(x)})" for x in suffixes) + f" ELSE {w} END"


def _loose_sql() -> str:
    out = "lower(s)"
    for c, to in zip(T.CYRILLIC, T.LOOSE, strict=True):
        out = f"replace({out}, '{c}', '{to}')"
    for pattern, to in T._FOLDS[:-1]:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return out


def _streamlined_sql(x: str) -> str:
    out = f"lower({x})"
    for c, to in zip(T.CYRILLIC, T.STREAMLINED, strict=True):
        out = f"replace({out}, '{c}', '{to}')"
    return out


#: A run of one character as one: without back references by looking at the character before.
_LOOSE = _loose_sql()
_SPACES = r"[\s\x0B\x1C-\x1F\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+"
_WS_TRIM = rf"trim(regexp_replace(regexp_replace({{0}}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{{{{AD}}}}\x{{{{61C}}}}\x{{{{200B}}}}-\x{{{{200F}}}}\x{{{{2028}}}}-\x{{{{202F}}}}\x{{{{2060}}}}-\x{{{{206F}}}}\x{{{{FEFF}}}}\x{{{{E0000}}}}-\x{{{{E007F}}}}]', '', 'g'), '{_SPACES}', ' ', 'g'))"


def _macros() -> str:
    stop = ", ".join(f"'{w}'" for w in T.STOPWORDS)
    same = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in T.SYNONYMS.items())
    asks = ", ".join(f"'{w}'" for w in T.QUESTION_WORDS)
    return rf"""
CREATE OR REPLACE TEMP MACRO lr_article(w) AS {_cut_sql('w', T.ARTICLE_SUFFIXES)};
CREATE OR REPLACE TEMP MACRO lr_inflect(w) AS {_cut_sql('w', T.INFLECTION_SUFFIXES)};
CREATE OR REPLACE TEMP MACRO lr_vowel(w) AS CASE WHEN length(w) >= 6 AND ends_with(w, 'ен') THEN left(w, length(w) - 2) || 'н' ELSE w END;
CREATE OR REPLACE TEMP MACRO lr_latin(w) AS CASE WHEN length(w) > 4 AND ends_with(w, 'ies') THEN left(w, length(w) - 3) || 'y'
  WHEN length(w) > 4 AND regexp_matches(w, '(ss|sh|ch|x|z)es$') THEN left(w, length(w) - 2)
  WHEN length(w) > 3 AND ends_with(w, 's') AND NOT regexp_matches(w, '(ss|us|is)$') THEN left(w, length(w) - 1) ELSE w END;
CREATE OR REPLACE TEMP MACRO lr_same(w) AS CASE w {same} ELSE w END;
CREATE OR REPLACE TEMP MACRO lr_cyrillic(w) AS [lr_vowel(v) FOR v IN [lr_inflect(u) FOR u IN [lr_article(w)]]][1];
CREATE OR REPLACE TEMP MACRO lr_stem(w) AS [lr_same(v) FOR v IN [CASE WHEN w >= 'Ѐ' AND length(w) >= 4 AND regexp_full_match(w, '\p{{Cyrillic}}+') THEN lr_cyrillic(w) WHEN ends_with(w, 's') AND regexp_full_match(w, '[a-z]+') THEN lr_latin(w) ELSE w END]][1];
CREATE OR REPLACE TEMP MACRO lr_stop(w) AS w IN ({stop});
CREATE OR REPLACE TEMP MACRO lr_words(s) AS regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}]+');
CREATE OR REPLACE TEMP MACRO lr_fold(s) AS regexp_replace(regexp_replace(lower(s), '\p{{Pd}}', '-', 'g'), '(^|[^\p{{L}}])(?:уеб|веб|web)[\s-]*(?:сайт|site)s?', '\1сайт', 'g');
CREATE OR REPLACE TEMP MACRO lr_tokens(s) AS regexp_extract_all(lr_fold(s), '[\p{{L}}\p{{N}}]+');
CREATE OR REPLACE TEMP MACRO lr_terms(s) AS [lr_stem(w) FOR w IN lr_tokens(s) IF NOT lr_stop(w) AND NOT regexp_full_match(w, '\p{{N}}+') AND length(w) >= 2];
CREATE OR REPLACE TEMP MACRO lr_topic(s) AS [w FOR w IN lr_tokens(s) IF NOT lr_stop(w)];
CREATE OR REPLACE TEMP MACRO lr_spelled(s) AS {_LOOSE};
CREATE OR REPLACE TEMP MACRO lr_once(s) AS [array_to_string([c[i] FOR i IN range(1, len(c) + 1) IF i = 1 OR c[i] <> c[i - 1]], '') FOR c IN [string_split(s, '')]][1];
CREATE OR REPLACE TEMP MACRO lr_loose(s) AS lr_once(lr_spelled(s));
CREATE OR REPLACE TEMP MACRO lr_asks(s) AS ends_with(trim(s), '?') OR coalesce(lr_words(s)[1] IN ({asks}), false);
"""


_M = _macros()
_FOLD = r"regexp_replace(regexp_replace(lower(text), '\\p{Pd}', '-', 'g'), '(^|[^\\p{L}])(?:уеб|веб|web)[\\s-]*(?:сайт|site)s?', '\\1сайт', 'g')".replace("\\\\", "\\")
_KW = "list_distinct([lr_stem(w) FOR w IN CASE WHEN len(lr_topic({0})) > 0 THEN lr_topic({0}) ELSE lr_tokens({0}) END])"
_TOKENS = r"""
segs AS (SELECT doc_id AS doc, unnest([trim(x) FOR x IN regexp_split_to_array(text, '[.!?;:,\n\r|•·()\[\]{}«»"“”„…—–]+') IF trim(x) <> '']) AS seg FROM documents),
toks AS (SELECT doc, [{'raw': w, 'stem': lr_stem(w), 'stop': lr_stop(w)} FOR w IN lr_tokens(seg)] AS t FROM segs),
runs AS (SELECT doc, n, unnest([t[i : i + n - 1] FOR i IN range(1, len(t) - n + 2)]) AS run FROM toks, (SELECT unnest([1, 2, 3]) AS n) WHERE len(t) >= n),
good AS MATERIALIZED (SELECT doc, n::INT AS n, array_to_string([CASE WHEN x.stop THEN x.raw ELSE x.stem END FOR x IN run], ' ') AS key, array_to_string([x.raw FOR x IN run], ' ') AS surface FROM runs
  WHERE NOT run[1].stop AND NOT run[-1].stop AND len([1 FOR x IN run IF x.stop]) <= n // 2 AND len([1 FOR x IN run IF regexp_full_match(x.raw, '\p{N}+') OR length(x.raw) < CASE WHEN n = 1 THEN 3 ELSE 2 END]) = 0),
mined AS MATERIALIZED (SELECT a.key, a.n, pages, total, display FROM (SELECT key, n, sum(c)::BIGINT AS total, arg_min(surface, (-c, length(surface), surface)) AS display FROM (SELECT key, n, surface, count(*) AS c FROM good GROUP BY ALL) GROUP BY key, n) a
  JOIN (SELECT key, count(DISTINCT doc) AS pages FROM good GROUP BY key HAVING count(DISTINCT doc) >= 3) b USING (key))"""

ORACLE_SQL = {
    "stem_terms": _M + "SELECT term, count(*) AS docs FROM (SELECT doc_id, unnest(list_distinct(lr_terms(text))) AS term FROM documents) GROUP BY term",
    "keyword_key": _M + f"SELECT p_partkey, array_to_string(list_sort({_KW.format('p_name')}), ' ') AS key, len({_KW.format('p_type')})::INT AS n_terms FROM part",
    "coverage": _M + f"""WITH a AS (SELECT conv_id, turn, {_KW.format('text')} AS kw FROM conversations WHERE role = 'user'), b AS (SELECT conv_id, turn - 1 AS turn, lr_terms(text) AS t FROM conversations WHERE role = 'assistant'),
c AS (SELECT conv_id, turn, kw, t, len(list_intersect(kw, t)) AS i FROM a JOIN b USING (conv_id, turn))
SELECT conv_id, turn, coalesce(floor(i / nullif(len(kw), 0)::DOUBLE * 1000 + 0.5), 0)::BIGINT AS coverage_milli, coalesce(i / nullif(len(kw), 0)::DOUBLE >= 0.999, false) AS contains, len(kw) > 0 AND t[1 : len(kw)] = kw AS opens,
  coalesce(floor(i / nullif(len(list_distinct(list_concat(kw, t))), 0)::DOUBLE * 1000 + 0.5), 0)::BIGINT AS jaccard_milli FROM c""",
    "question_shapes": _M + "SELECT lr_asks(text) AS question, CASE WHEN n < 150 THEN 'very_short' WHEN n < 400 THEN 'short' WHEN n < 900 THEN 'medium' WHEN n < 1800 THEN 'long' ELSE 'very_long' END AS bucket, count(*) AS turns FROM (SELECT text, len(lr_words(text)) AS n FROM conversations) GROUP BY ALL",
    "phrase_document_frequency": _M + f"WITH {_TOKENS} SELECT key, n, pages, total, display FROM mined",
    "prune_subsumed_phrases": _M + f"""WITH {_TOKENS},
split_ AS MATERIALIZED (SELECT string_split(key, ' ') AS w, n, pages FROM mined WHERE n > 1),
inner_ AS (SELECT unnest(list_concat(w, CASE WHEN n = 3 THEN [w[1] || ' ' || w[2], w[2] || ' ' || w[3]] ELSE [] END)) AS key, pages FROM split_),
most AS (SELECT key, max(pages) AS p FROM inner_ GROUP BY key)
SELECT key, n, pages FROM mined LEFT JOIN most USING (key) WHERE coalesce(p, 0) < pages * 0.85::DOUBLE""",
    "text_cleaning": _M + f"""WITH s AS (SELECT doc_id AS doc, text, {_WS_TRIM.format('text')} AS x, lr_spelled(text) AS spelled, regexp_replace(regexp_replace({_streamlined_sql('text')}, '[^a-z0-9]+', '-', 'g'), '^-+', '') AS slug FROM documents),
h AS (SELECT *, left(x, 79) AS head FROM s), p AS (SELECT *, CASE WHEN contains(head, ' ') THEN length(head) - strpos(reverse(head), ' ') END AS pos FROM h)
SELECT doc, md5(x) AS squashed, md5({_FOLD}) AS folded, CASE WHEN length(x) <= 80 THEN x ELSE rtrim(CASE WHEN pos > 48 THEN left(head, pos) ELSE head END) || '…' END AS clipped, regexp_replace(left(slug, 40), '-+$', '') AS slug, md5(lr_once(spelled)) AS loose FROM p""",
    "duplicate_values_window": r"""WITH d AS (SELECT doc_id AS doc, lang, trim(regexp_replace(lower(text), '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS v FROM documents)
SELECT doc, lang, CASE WHEN v IS NULL OR v = '' THEN 1 ELSE count(*) OVER (PARTITION BY lang, v) END::BIGINT AS same FROM d""",
}


def _clusters_sql(terms: str) -> str:
    """c(scope, place, topic, pages, examples): headings one after the other, the unions of terms as the state of a recursion by scope."""
    return f"""d AS (SELECT concat_ws('/', source, lang) AS scope, doc_id AS ordinal, doc_id::VARCHAR AS doc, string_split(text, chr(10))[1] AS heading FROM documents), dt AS (SELECT *, {terms} AS t FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY ordinal) AS n FROM dt WHERE len(t) > 0),
s AS (SELECT DISTINCT scope, 0::BIGINT AS n, []::VARCHAR[][] AS u, 0::BIGINT AS place FROM k UNION ALL
  SELECT scope, n, CASE WHEN place > len(u) THEN list_append(u, t) ELSE [CASE WHEN i = place THEN list_distinct(list_concat(u[i], t)) ELSE u[i] END FOR i IN range(1, len(u) + 1)] END, place
  FROM (SELECT *, CASE WHEN list_max(likes) >= 0.4::DOUBLE THEN list_position(likes, list_max(likes)) ELSE len(u) + 1 END::BIGINT AS place
    FROM (SELECT k.scope, k.n, k.t, s.u, [len(list_intersect(k.t, x)) / len(list_distinct(list_concat(k.t, x)))::DOUBLE FOR x IN s.u] AS likes FROM s JOIN k ON k.scope = s.scope AND k.n = s.n + 1))),
h AS (SELECT scope, place, heading, count(*) AS n, min(ordinal) AS first FROM (SELECT scope, n, place FROM s) JOIN k USING (scope, n) GROUP BY ALL), p AS (SELECT scope, place, count(DISTINCT doc) AS pages FROM (SELECT scope, n, place FROM s) JOIN k USING (scope, n) GROUP BY ALL),
c AS (SELECT scope, place, arg_min(heading, (-n, length(heading), heading)) AS topic, list(heading ORDER BY first)[1:3] AS examples FROM h GROUP BY ALL)"""


ORACLE_SQL |= {
    "cluster_headings": _M + f"WITH RECURSIVE {_clusters_sql('list_distinct(lr_terms(heading))')} SELECT scope, topic, pages, examples FROM c JOIN p USING (scope, place)",
    "subtopics": _M + f"""WITH RECURSIVE {_clusters_sql("[x FOR x IN list_distinct(lr_terms(heading)) IF NOT list_contains(" + _KW.format("'the of and la de der die en'") + ", x)]")},
a AS (SELECT scope, count(DISTINCT doc) AS n FROM d GROUP BY scope) SELECT scope, topic, pages, row_number() OVER (PARTITION BY scope ORDER BY pages DESC, topic)::INT AS place
FROM c JOIN p USING (scope, place) JOIN a USING (scope) WHERE pages >= greatest(2, ceil(n * 0.05::DOUBLE)) QUALIFY row_number() OVER (PARTITION BY scope ORDER BY pages DESC, topic) <= 12""",
    "cluster_questions": _M + """WITH RECURSIVE q AS (SELECT conv_id % 4 AS scope, conv_id * 1000 + turn AS ordinal, text, list_distinct(lr_terms(text)) AS t FROM conversations WHERE role = 'user'), k AS (SELECT * FROM q WHERE len(t) > 0),
e AS (SELECT a.ordinal AS v, b.ordinal AS u FROM k a JOIN k b ON a.scope = b.scope AND b.ordinal < a.ordinal AND len(list_intersect(a.t, b.t)) >= least(len(a.t), len(b.t)) * 0.5::DOUBLE),
reach(v, u) AS (SELECT ordinal, ordinal FROM k UNION SELECT r.v, e.u FROM reach r JOIN e ON e.v = r.u), l AS (SELECT v AS ordinal, min(u) AS label FROM reach GROUP BY v),
o AS (SELECT scope, label, row_number() OVER (PARTITION BY scope ORDER BY label) - 1 AS cluster FROM (SELECT DISTINCT scope, label FROM l JOIN k USING (ordinal)))
SELECT scope, ordinal, text, cluster FROM k JOIN l USING (ordinal) JOIN o USING (scope, label)""",
}
