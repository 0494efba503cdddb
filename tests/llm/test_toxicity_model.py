"""The label model on votes drawn from a known one, and the scores against plain versions."""

import collections
import math
import random
import re

import numpy as np
import pytest

from lumenrank.llm import _words, toxicity

SF = "/root/testdata/sf0.001"


def drawn(seed, n=20_000):
    """Votes with some that repeat others, some that exclude others, and some of their own."""
    draw = np.random.default_rng(seed)
    y = draw.random(n) < 0.2
    votes = np.zeros((n, toxicity.VOTERS), int)
    for k in range(4):
        votes[:, k] = draw.random(n) < np.where(y, 0.5, 0.04)
    copy = draw.random(n) < 0.95
    votes[:, 4] = np.where(copy, votes[:, 0], draw.random(n) < 0.1)
    votes[:, 5] = np.where(copy, votes[:, 0], draw.random(n) < 0.1)
    votes[:, 6] = (draw.random(n) < np.where(y, 0.6, 0.3)) & (votes[:, 1] == 0)
    return votes, y


def table(votes, labels):
    counted = collections.Counter((tuple(v), int(y)) for v, y in zip(votes.tolist(), labels.tolist()))
    rows = sorted(counted)
    return np.array([v for v, _ in rows]), np.array([y for _, y in rows]), np.array([counted[r] for r in rows], float)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_posteriors_of_voters_that_hang_together(seed):
    votes, y = drawn(seed)
    bits, labels, n = table(votes, np.full(len(y), -1))
    post = dict(zip(map(tuple, bits.tolist()), toxicity.label_model(bits, labels, n)))
    mine = np.array([post[tuple(v)] for v in votes.tolist()])
    # the best possible: the share of toxic texts under each combination of votes
    share = collections.defaultdict(list)
    for v, t in zip(votes.tolist(), y):
        share[tuple(v)].append(t)
    best = np.array([np.mean(share[tuple(v)]) for v in votes.tolist()])
    right, most = ((mine >= 0.5) == y).mean(), ((best >= 0.5) == y).mean()
    assert right > most - 0.02, (right, most)
    assert abs(mine.mean() - y.mean()) < 0.1  # two of ten voters are noise given the class


def test_the_tree_has_what_hangs_together():
    votes, _ = drawn(4)
    bits, _, n = table(votes, np.full(len(votes), -1))
    edges = {frozenset(e) for e in toxicity._dependences(bits.astype(float), (n * 0.8, n * 0.2)) if e[1] >= 0}
    assert {frozenset((0, 4)), frozenset((0, 5))} <= edges or {frozenset((0, 4)), frozenset((4, 5))} <= edges or {frozenset((0, 5)), frozenset((4, 5))} <= edges
    assert frozenset((1, 6)) in edges and len(edges) == toxicity.VOTERS - 1


def test_labels_are_one_more_voter():
    votes, y = drawn(5)
    said = np.where(np.arange(len(y)) % 4 == 0, y, -1).astype(int)
    bits, labels, n = table(votes, said)
    post = dict(zip(zip(map(tuple, bits.tolist()), labels.tolist()), toxicity.label_model(bits, labels, n)))
    mine = np.array([post[tuple(v), t] for v, t in zip(votes.tolist(), said.tolist())])
    assert ((mine >= 0.5) == y)[said >= 0].mean() > 0.97 and ((mine >= 0.5) == y)[said < 0].mean() > 0.85


def test_scores_against_plain_versions(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    stems, (weights, words), plain = toxicity._learn(docs, labels, "doc_id", "text")
    marked = {r.doc_id: r.toxic for r in labels.collect()}
    search = toxicity._search(stems)
    rows = [(r.id, r.text or "", r.held_out) for r in plain.collect()]
    votes = {t: toxicity.votes_of(t, search) for _, t, _ in rows}
    learned = [(votes[t], marked.get(i, -1), t) for i, t, held in rows if not held]
    counted = collections.Counter((v, y) for v, y, _ in learned)
    keys = sorted(counted)
    post = toxicity.label_model(np.array([[v >> k & 1 for k in range(toxicity.VOTERS)] for v, _ in keys]), np.array([y for _, y in keys]), np.array([counted[k] for k in keys], float))
    share = collections.defaultdict(list)
    for (v, _), p in zip(keys, post):
        share[v].append((p, counted[v, _]))
    post = {v: sum(p * n for p, n in some) / sum(n for _, n in some) for v, some in share.items()}

    def buckets(t):
        found = set()
        for w in re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()):
            ((_, _, h, _),) = _words.hashed_words([w])
            found.add(int(h[0, 0]) >> 49)
        return found

    toxic, seen = collections.Counter(), collections.Counter()
    for v, _, t in learned:
        for b in buckets(t):
            seen[b] += 1
            toxic[b] += round(post[v] * 1000) / 1000
    prior = min(max(sum(round(post[v] * 1000) / 1000 for v, _, _ in learned) / len(learned), 1e-4), 0.5)
    odds = lambda p: math.log(p / (1 - p))
    weight_of = lambda b: odds(min(max((toxic[b] + toxicity.PRIOR_ROWS * prior) / (seen[b] + toxicity.PRIOR_ROWS), 1e-4), 1 - 1e-4)) - odds(prior)
    for b in list(seen)[:300]:
        assert words[b] == pytest.approx(weight_of(b), abs=1e-4)
    got = {r.id: r.score for r in toxicity.score_toxicity(docs, labels).collect()}
    draw = random.Random(1)
    for i, t, _ in draw.sample(rows, 60):
        at = buckets(t)
        total = weights[-1] + sum(weights[k] for k in range(toxicity.VOTERS) if votes[t] >> k & 1) + (weights[-2] * sum(weight_of(b) for b in at) / math.sqrt(len(at)) if at else 0)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-3)
