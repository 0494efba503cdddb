"""Distributed clusterings and reachability against the plain ones, one row after the other."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from lumenrank.operators import clusters, graph, phrases


def greedy_headings(rows, least):
    """rows (ordinal, doc, heading, terms) -> clusters as sets of (ordinal, doc, heading)."""
    unions, members = [], []
    for ordinal, doc, heading, terms in sorted(rows, key=lambda r: r[:3]):
        likes = [len(terms & u) / len(terms | u) for u in unions]
        best = max(likes, default=0)
        if best >= least:
            at = likes.index(best)
        else:
            at = len(unions)
            unions.append(set())
            members.append(set())
        unions[at] |= terms
        members[at].add((ordinal, doc, heading))
    return {frozenset(m) for m in members}


def greedy_questions(rows, least):
    """rows (ordinal, text, terms) -> {(ordinal, text): cluster}."""
    members, out = [], {}
    for ordinal, text, terms in sorted(rows, key=lambda r: r[:2]):
        at = next((c for c, m in enumerate(members) if any(len(terms & x) / min(len(terms), len(x)) >= least for x in m)), len(members))
        if at == len(members):
            members.append([])
        members[at].append(terms)
        out[ordinal, text] = at
    return out


def texts(seed, n, vocabulary, most, hot):
    draw = random.Random(seed)
    words = [f"q{i}x" for i in range(vocabulary)]
    out = []
    for _ in range(n):
        t = draw.sample(words, draw.randint(1, most))
        if draw.random() < hot:
            t.insert(draw.randint(0, len(t)), "hot")
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("seed,vocabulary,most,hot", [(1, 12, 4, 0.4), (3, 25, 2, 0.2), (4, 200, 9, 0.9)])
def test_headings_as_one_after_the_other(spark, seed, vocabulary, most, hot):
    found = texts(seed, 220, vocabulary, most, hot)
    rows = [("ab"[i % 2], i // 3, f"d{i % 40}", t) for i, t in enumerate(found)] + [("a", 5, None, "hot"), (None, 1, "d", "hot q1x"), (None, 2, "d", None), ("a", 3, "d", "the of")]
    df = spark.createDataFrame(rows, "scope string, ordinal long, doc string, heading string").repartition(5)
    got = collections.defaultdict(lambda: collections.defaultdict(set))
    for r in clusters.heading_clusters(df).collect():
        got[r.scope][r.part, r.cluster].add((r.ordinal, r.doc or "", r.heading))
    for scope in ("a", "b", None):
        of = [(o, d or "", h, frozenset(h.split())) for s, o, d, h in rows if s == scope and h and h != "the of"]
        assert {frozenset(x) for x in got[scope].values()} == greedy_headings(of, 0.4)


@pytest.mark.parametrize("seed,vocabulary,most,hot", [(2, 60, 6, 0.7), (3, 30, 2, 0.1), (4, 300, 9, 0.95), (5, 9, 7, 0.5)])
def test_questions_as_one_after_the_other(spark, seed, vocabulary, most, hot):
    found = texts(seed, 160, vocabulary, most, hot)
    rows = [("ab"[i % 2], i // 2, t) for i, t in enumerate(found)] + [("a", 400 + i, found[0]) for i in range(20)] + [("a", 2, "hot"), ("a", 2, "hot"), (None, 1, "hot q1x"), (None, 2, None), ("b", 3, "the of")]
    df = spark.createDataFrame(rows, "scope string, ordinal long, text string").repartition(5)
    out = clusters.cluster_questions(df)
    got = [tuple(r) for r in out.select("scope", "ordinal", "text", "cluster").collect()]
    wanted = {s: greedy_questions({(o, t, frozenset(t.split())) for x, o, t in rows if x == s and t and t != "the of"}, 0.5) for s in ("a", "b", None)}
    assert collections.Counter(got) == collections.Counter((s, o, t, wanted[s][o, t]) for s, o, t in rows if t and t != "the of")


def test_topics_of_clusters(spark):
    rows = [("s", 0, "p1", "Red prices"), ("s", 1, "p1", "red price"), ("s", 2, "p2", "Red prices"), ("s", 3, "p3", "contact"), ("s", 4, "p3", "Prices, red")]
    got = clusters.cluster_headings(spark.createDataFrame(rows, "scope string, ordinal long, doc string, heading string")).collect()
    assert sorted((r.topic, r.pages, r.examples) for r in got) == [("Red prices", 3, ["Red prices", "red price", "Prices, red"]), ("contact", 1, ["contact"])]


def test_empty_tables(spark):
    assert clusters.cluster_headings(spark.createDataFrame([], "scope string, ordinal long, doc string, heading string")).collect() == []
    assert clusters.cluster_questions(spark.createDataFrame([], "scope string, ordinal long, text string")).collect() == []


@pytest.mark.parametrize("seed", range(2))
def test_least_reached_and_components(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7)]
    df = spark.createDataFrame(edges, "u long, v long")

    def reached(arcs):
        out = {}
        for x in {y for e in arcs for y in e if e[0] != e[1]}:
            seen, todo = {x}, [x]
            while todo:
                at = todo.pop()
                new = {v for u, v in arcs if u == at} - seen
                seen |= new
                todo += new
            out[x] = min(seen)
        return out

    assert {r.node: r.label for r in graph.least_reached(df).collect()} == reached(edges)
    assert {r.node: r.label for r in graph.components(df).collect()} == reached(edges + [(v, u) for u, v in edges])


def test_edges_of_questions_are_numbers(spark, monkeypatch):
    """Rounds over edges shuffle them again and again: they hold no texts, and no pair of sets twice."""
    seen = []
    monkeypatch.setattr(clusters, "least_reached", lambda edges: seen.append(edges) or graph.least_reached(edges))
    found = texts(6, 60, 20, 6, 0.8)
    clusters.cluster_questions(spark.createDataFrame([("a", i, t) for i, t in enumerate(found)], "scope string, ordinal long, text string")).collect()
    assert [f.dataType.simpleString() for f in seen[0].schema.fields] == ["bigint", "bigint"]


def test_similar_sets_each_pair_once(spark):
    found = [sorted(set(t.split())) for t in texts(8, 120, 30, 8, 0.5)]
    sets = [("s", i, t) for i, t in enumerate(dict.fromkeys(map(tuple, found))) if len(t) > 2]
    got = [(r.c, r.d) for r in clusters.similar_sets(spark.createDataFrame(sets, "scope string, id long, terms array<string>"), 0.5).collect()]
    want = [(i, j) for _, i, a in sets for _, j, b in sets if i < j and len(set(a) & set(b)) * 2 >= min(len(a), len(b))]
    assert sorted(got) == sorted(want)


def test_ties_of_headings_are_few(spark, monkeypatch):
    """A term that one heading has alone ties nothing, and headings that meet at many terms are tied once."""
    seen = []
    monkeypatch.setattr(clusters, "components", lambda edges: seen.append(edges.where("u <> v").distinct().count()) or graph.components(edges))
    shared = " ".join(f"q{i}x" for i in range(30))
    rows = [("s", i, f"d{i}", f"{shared} own{i}x more{i}x") for i in range(10)]
    found = clusters.heading_clusters(spark.createDataFrame(rows, "scope string, ordinal long, doc string, heading string")).collect()
    assert len({(r.part, r.cluster) for r in found}) == 1 and seen[0] <= 20


def as_frame(spark, found):
    return spark.createDataFrame([("s", i, f"d{i}", t) for i, t in enumerate(found)], "scope string, ordinal long, doc string, heading string")


def test_headings_that_never_meet_are_apart(spark):
    """Common terms alone make no part that one task goes over in order; copies that differ little make one."""
    found = [f"common1x common2x q{i}a q{i}b q{i}c q{i}d" for i in range(40)] + [f"like1x like2x like3x r{i}a" for i in range(9)]
    got = clusters.heading_clusters(as_frame(spark, found)).collect()
    parts = collections.Counter(r.part for r in got)
    assert len(parts) == 41 and max(parts.values()) == 9


@pytest.mark.parametrize("one_hash", [False, True])
def test_heading_like_a_union_and_no_member(spark, monkeypatch, one_hash):
    """The third is like what the first two make together; sets of one hash are told apart."""
    if one_hash:
        monkeypatch.setattr(clusters, "set_id", lambda: F.lit(7).cast("long"))
    found = ["q1x q2x q3x q4x q5x q6x", "q3x q4x q5x q6x q7x q8x", "q1x q2x q7x q8x", "q9x q10x", "q9x q10x", "q11x q12x", "q1x q2x q7x q8x"]
    got = collections.defaultdict(set)
    for r in clusters.heading_clusters(as_frame(spark, found)).collect():
        got[r.part, r.cluster].add((r.ordinal, r.doc, r.heading))
    assert {frozenset(x) for x in got.values()} == greedy_headings([(i, f"d{i}", t, frozenset(t.split())) for i, t in enumerate(found)], 0.4)


def test_components_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(graph, "FEW", 0)
    got = {r.node: r.label for r in graph.components(spark.createDataFrame([(1, 2), (3, 2), (5, 4), (6, 6)], "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_subtopics_need_no_examples(spark, monkeypatch):
    """Only topics of clusters on enough pages are made, and no examples."""

    def none(*_):
        raise AssertionError("examples were made")

    monkeypatch.setattr(clusters, "top_per", none)
    found = ["red prices", "Prices red", "red price", "contact", "our team", "team", "history"]
    got = phrases.subtopics(as_frame(spark, found)).collect()
    assert sorted((r.place, r.topic, r.pages) for r in got) == [(1, "red price", 3), (2, "team", 2)]
