"""Near copies with a part added, cut or replaced, which fingerprints alone often miss."""

import random

import pytest

import corpus_pipeline
from lumenrank.llm import overlap, simhash


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def copies(draw, n, aim, kind):
    """A text of n words and a copy with a block appended, cut off or replaced, alike at ``aim`` or a little more."""
    new = lambda k: [f"w{draw.randrange(10**6)}" for _ in range(k)]
    base, best = new(n), None
    for k in range(1, n):
        if kind == "appended":
            other = base + new(k)
        elif kind == "cut":
            other = base[: n - k]
        else:
            at = draw.randrange(n - k)
            other = base[:at] + new(k) + base[at + k :]
        if jaccard(" ".join(base), " ".join(other)) < aim:
            return best
        best = " ".join(base), " ".join(other)
    return best


def cells(pairs=15):
    draw = random.Random(9)
    asked = [(kind, n, aim) for kind in ("appended", "cut", "block") for n in (60, 200, 600) for aim in (0.8, 0.85, 0.9) for _ in range(pairs)]
    made = [(*x, copies(draw, x[1], x[2], x[0])) for x in asked]
    return [(*x, *texts) for *x, texts in made if texts]  # one new word in 60 is already below 0.85


def test_copies_with_a_part_added_cut_or_replaced(spark):
    made = cells()
    assert all(jaccard(a, b) >= 0.8 for *_, a, b in made)
    rows = [(2 * i + j, t) for i, (*_, a, b) in enumerate(made) for j, t in enumerate((a, b))]
    draw, apart = random.Random(4), []
    for i in range(100):  # alike at about 0.5: linked by neither
        a = [f"v{draw.randrange(10**6)}" for _ in range(200)]
        apart += [(10**6 + 2 * i, " ".join(a)), (10**6 + 2 * i + 1, " ".join(a[:70] + [f"v{draw.randrange(10**6)}" for _ in range(65)] + a[135:]))]
    df = spark.createDataFrame(rows + apart, "doc_id long, text string").repartition(8)
    kept = {r.doc_id for r in corpus_pipeline.one_of_each(spark, df, "").collect()}
    assert len(made) > 360
    assert [made[i][:3] for i in range(len(made)) if 2 * i + 1 in kept] == []
    assert all(2 * i in kept for i in range(len(made)))
    far = [bin(simhash.fingerprint(apart[i][1].encode(), 2, True) ^ simhash.fingerprint(apart[i + 1][1].encode(), 2, True)).count("1") > 6 for i in range(0, 200, 2)]
    assert [apart[i + 1][0] for i, f in zip(range(0, 200, 2), far) if f and apart[i + 1][0] not in kept] == []


def test_sets_leave_case_and_punctuation_out():
    sets = list(overlap.shingle_sets([b"a b c d e f g h i", b"A, b c d e f g h", b"", b"a b", b"a  B!", b"a"], b",!"))
    assert [len(s) for s in sets] == [5, 4, 1, 1, 1, 1]
    assert set(sets[1].tolist()) < set(sets[0].tolist())
    assert len({overlap.set_hash(s) for s in sets}) == 5 and overlap.set_hash(sets[3]) == overlap.set_hash(sets[4])


@pytest.mark.parametrize("radius", [2, 5, 6, 7, 8])
def test_every_mask_keeps_enough_bits(radius):
    made, draw = simhash.masks(radius), random.Random(radius)
    assert min(m.bit_count() for m in made) >= (32 if radius in (2, 6) else 16)
    for _ in range(2000):
        diff = sum(1 << b for b in draw.sample(range(64), radius))
        assert any(not m & diff for m in made)


@pytest.mark.parametrize("block", [2, 7, 256])
def test_blocks_find_every_link(spark, monkeypatch, block):
    monkeypatch.setattr(overlap, "BLOCK", block)
    draw, rows, sets = random.Random(block), [], {}
    for key in range(4):
        base = draw.sample(range(10**9), 40)
        for m in range(draw.choice([2, 9, 30])):
            s = key * 100 + m
            kept = base[: draw.randrange(28, 41)] + draw.sample(range(10**9, 2 * 10**9), draw.randrange(6))
            sets[s] = sorted(set(kept))
            rows.append((key, s, len(sets[s]), draw.choice([1, 1, 1, 50 + m, 60 + m % 3]) + 1000 * key))
    members = spark.createDataFrame(rows, "key long, s long, n int, root long")
    table = spark.createDataFrame(list(sets.items()), "s long, hashes array<long>")
    got = {frozenset((r.u, r.v)) for r in overlap._in_blocks(members, table, 0.8).collect()}
    want = set()
    for i, (k, s, _, root) in enumerate(rows):
        for k2, s2, _, other in rows[:i]:
            a, b = set(sets[s]), set(sets[s2])
            if k == k2 and root != other and len(a & b) >= 0.8 * len(a | b):
                want.add(frozenset((root, other)))
    assert want and got == want
