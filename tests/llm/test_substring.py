"""Passages against a plain version: words that a polynomial hash takes for one another, hot windows, repeated ids."""

import collections
import random

import pytest

from lumenrank.llm import _words, substring


def plain(docs, size):
    words = [(i, t.split()) for i, t in docs]
    first = {}
    for i, w in words:
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return collections.Counter(out)


def removed(spark, docs, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    return collections.Counter(map(tuple, substring.remove_repeats(df, **more).collect()))


def thue_morse(n, a, b):
    return "".join((a, b)[i.bit_count() & 1] for i in range(n))


@pytest.mark.parametrize("n", [8, 32, 64, 1024, 4096])
def test_words_that_collide_in_any_polynomial(spark, n):
    one, two = thue_morse(n, "a", "b"), thue_morse(n, "b", "a")
    ((_, _, h, _),) = _words.hashed_words([f"{one} {two}".encode()])
    assert h[0, 0] != h[0, 1] and h[1, 0] != h[1, 1]
    rest = " ".join(f"w{i}" for i in range(49))
    docs = [(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{one} {rest}")]
    assert removed(spark, docs) == plain(docs, 50)


def corpus(seed):
    draw = random.Random(seed)
    passages = [" ".join(f"p{draw.randrange(50)}" for _ in range(draw.randrange(5, 40))) for _ in range(6)]
    docs = []
    for i in range(120):
        parts = [draw.choice([passages[0], draw.choice(passages), "x " * draw.randrange(30), " ".join(f"u{draw.randrange(10**6)}" for _ in range(draw.randrange(20)))]) for _ in range(draw.randrange(5))]
        docs.append((i // 2 * 2 if i % 10 == 0 else i, " ".join(parts)))
    return [*docs, (7, docs[40][1]), (200, docs[40][1]), (200, docs[41][1]), (5, docs[40][1])]


@pytest.mark.parametrize("few", [2, 5, 4096])
def test_hot_and_other_windows(spark, few):
    docs = corpus(few)
    want = plain(docs, 8)
    assert sum(r[2] > 0 for r in want) > 40
    assert removed(spark, docs, size=8, gram=4, few=few, most_cells=1 << 17) == want


def test_rows_of_one_id_keep_apart(spark):
    same, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = [(1, same), (2, same), (2, other), (2, same + " " + other)]
    assert removed(spark, docs) == plain(docs, 50)
