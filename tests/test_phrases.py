"""Phrases and terms counted over texts as arrays against plain counting, one document after the other."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from lumenrank.functions import text as T
from lumenrank.operators import phrases


def mined(rows, most_words, least):
    """rows (scope, text) -> {(scope, key): (n, pages, total, display)}, each document by Analyzer's words."""
    analyze, pages, said = T.Analyzer(), collections.Counter(), collections.defaultdict(collections.Counter)
    for scope, text in rows:
        met = set()
        for words in analyze(text or ""):
            for i in range(len(words)):
                for n in range(1, min(most_words, len(words) - i) + 1):
                    run = words[i : i + n]
                    if run[0][2] or run[-1][2] or not all(w[3] for w in run) or n == 1 and len(run[0][0]) < 3 or sum(w[2] for w in run) > n // 2:
                        continue
                    key = (scope, n, " ".join(w[1] for w in run))
                    met.add(key)
                    said[key][" ".join(w[0] for w in run)] += 1
        pages.update(met)
    best = lambda c: min(c, key=lambda s: (-c[s], len(s), s))
    return {(s, k): (n, pages[s, n, k], sum(c.values()), best(c)) for (s, n, k), c in said.items() if pages[s, n, k] >= least(s)}


def made(seed):
    draw = random.Random(seed)
    words = ["price", "prices", "Цени", "цената", "the", "of", "a", "x", "12", "red", "cars", "web", "site", "über", "ﬁne", "class", "ab"]
    glue = [" ", " ", " ", ". ", ", ", "…", "\n", "-", "，", "«"]
    return [(draw.choice(["a", "b", "c", None]), "".join(draw.choice(words) + draw.choice(glue) for _ in range(draw.randint(0, 40)))) for _ in range(150)] + [("a", None), ("b", "")]


@pytest.mark.parametrize("seed,most_words,portion", [(1, 3, 1 << 20), (2, 3, 50), (3, 5, 200)])
def test_phrases_as_counted_one_by_one(spark, monkeypatch, seed, most_words, portion):
    monkeypatch.setattr(phrases, "PORTION", portion)
    rows = made(seed)
    df = spark.createDataFrame(rows, "scope string, text string").repartition(3)
    got = {(r.scope, r.key): (r.n, r.pages, r.total, r.display) for r in phrases.mine_phrases(df, most_words, scope=F.col("scope")).collect()}
    assert got == mined(rows, most_words, lambda s: 2)
    got = {(None, r.key): (r.n, r.pages, r.total, r.display) for r in phrases.mine_phrases(df, most_words, 3).collect()}
    assert got == mined([(None, t) for _, t in rows], most_words, lambda s: 3)
    least = spark.createDataFrame([("a", 9), ("b", 2)], "scope string, least long")
    got = {(r.scope, r.key): (r.n, r.pages, r.total, r.display) for r in phrases.mine_phrases(df, most_words, scope=F.col("scope"), least_of=least).collect()}
    assert got == mined([r for r in rows if r[0] in ("a", "b")], most_words, {"a": 9, "b": 2}.get)


def test_mining_is_done_once_before_pruning(spark):
    read = spark.sparkContext.accumulator(0)

    def noted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    stats = spark.createDataFrame([("red cars", 2, 5), ("red", 1, 5), ("cars", 1, 9)], "key string, n int, pages int").mapInArrow(noted, "key string, n int, pages int")
    assert {r.key for r in phrases.prune_subsumed(stats).collect()} == {"red cars", "cars"}
    assert read.value == 3


@pytest.mark.parametrize("seed", [4, 5])
def test_terms_as_the_expression_has_them(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, "scope string, text string").withColumn("own", F.col("scope") == "a").repartition(3)
    each = df.select("scope", "own", F.explode(F.array_distinct(T.terms(F.col("text")))).alias("term"))
    for by in ([], ["scope"], ["scope", "own"]):
        want = each.groupBy(*by, "term").count()
        assert collections.Counter(map(tuple, phrases.count_terms(df, by).collect())) == collections.Counter(map(tuple, want.collect()))


def test_terms_of_documents_leave_python_counted(spark):
    """A document's words leave the task that reads it as numbers of documents: at most a row for each term of a portion."""
    df = spark.createDataFrame([("red cars price",)] * 500, "text string").coalesce(1)
    rows = phrases.count_terms(df, []).collect()
    assert {(r.term, r.docs) for r in rows} == {("red", 500), ("car", 500), ("price", 500)}


def test_parts_as_the_analyzer_has_them():
    draw = random.Random(7)
    pool = [chr(c) for c in [*range(0x3000), *range(0xFF00, 0xFFFF), 0x1F600] if not 0xD800 <= c < 0xE000] + list(" .,«web site сайтΣ‥；...…–") * 200
    odd = ["".join(draw.choice(pool) for _ in range(draw.randint(1, 60))) for _ in range(3000)] + ["web. site", "WEB-Sites a.b", "уеб–сайт ΑΣ. ΑΣ", "a，b。c", "web\nsite"]
    analyze = T.Analyzer()
    for text in odd:
        got = [[]]
        for w in T.parts(text):
            got[-1].append(w) if w not in "«." else got.append([])
        assert [x for x in got if x] == [[w[0] for w in words] for words in analyze(text)]
