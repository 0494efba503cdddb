"""Near vectors against all cosines, on made groups and on odd rows."""

import math

import numpy as np
import pytest

from lumenrank.llm import crosspoly, queries

SCHEMA = "vec_id long, embedding array<double>, label int, id long, digest string, v int, key int"


def brute(rows, least=0.95):
    """(vec_id, n_links, component_id, kept) by all pairs."""
    ok = [i for i, (_, v) in enumerate(rows) if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = {i: set() for i in range(len(rows))}
    for dim in {len(rows[i][1]) for i in ok}:
        at = [i for i in ok if len(rows[i][1]) == dim]
        x = np.array([rows[i][1] for i in at], float)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        for a, b in zip(*np.nonzero(x @ x.T >= least), strict=True):
            if a != b:
                near[at[a]].add(at[b])
    out, seen = [None] * len(rows), set()
    for i in near:
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - group:
                group.add(j)
                todo.append(j)
        seen |= group
        ids = [rows[j][0] for j in group if rows[j][0] is not None]
        first = min(ids) if ids else None
        for j in group:
            out[j] = (rows[j][0], len(near[j]), first, first is not None and rows[j][0] == first)
    return sorted(out, key=repr)


def groups(draw, dim, sizes, spread):
    out = []
    for size in sizes:
        centre = draw.normal(size=dim)
        centre /= np.linalg.norm(centre)
        out += [centre + draw.normal(size=dim) * spread / math.sqrt(dim) for _ in range(size)]
    return out


def checked(spark, tmp_path, rows):
    at = str(tmp_path)
    spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], i and i % 3, 1, "d", 2, 3) for i, v in rows], SCHEMA).repartition(3).write.parquet(f"{at}/embeddings.parquet")
    found = queries.op13_embedding_near_dedup(spark, at)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(map(tuple, found.collect()), key=repr)


def test_given_vectors(spark):
    at = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{at}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op13_embedding_near_dedup(spark, at).collect()), key=repr) == brute(rows)


def test_groups_on_both_sides_of_the_bound(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(crosspoly, "BLOCK", 64)  # so that buckets of the large group are split
    draw = np.random.default_rng(5)
    vectors = [draw.normal(size=64) for _ in range(400)]
    for spread in (0.02, 0.1, 0.2, 0.23, 0.3):
        vectors += groups(draw, 64, [2, 3, 5, 8, 13], spread)
    vectors += groups(draw, 64, [300], 0.15) + [vectors[0]] * 200 + [vectors[1] * 2, vectors[1] * -1]
    order = draw.permutation(len(vectors))
    rows = [(int(i) - 50, vectors[i]) for i in order]
    wanted = brute(rows)
    assert max(r[1] for r in wanted) >= 299 and len({r[2] for r in wanted}) > 300
    assert checked(spark, tmp_path, rows) == wanted


@pytest.mark.parametrize("dim", [1, 2, 7, 33, 200])
def test_other_lengths(spark, tmp_path, dim):
    draw = np.random.default_rng(dim)
    vectors = [draw.normal(size=dim) for _ in range(60)] + groups(draw, dim, [2, 5, 9], 0.2)
    rows = list(enumerate(vectors))
    assert checked(spark, tmp_path, rows) == brute(rows)


def test_odd_rows(spark, tmp_path):
    a = [0.6, 0.8] + [0.0] * 6
    rows = [
        (1, None), (2, []), (3, [0.0] * 8), (4, [-0.0] * 8), (5, [None, *a[1:]]), (6, [math.nan, *a[1:]]), (7, [math.inf, *a[1:]]), (8, a), (9, a), (9, a), (None, a), (11, [x * 1e300 for x in a]),
        (12, [x * 1e-310 for x in a]), (13, [*a, 0.0]), (14, [*a, -0.0]), (15, [-x for x in a]), (None, [5.0, 0, 0]), (None, [5.0, 0.1, 0]), (None, None), (20, [1e308, 1e308] + [0.0] * 6), (21, [1.0, 1.0] + [0.0] * 6), (22, [1.0] * 8), (22, [-1.0] * 8),
    ]
    assert checked(spark, tmp_path, rows) == brute(rows)


def test_pairs_at_the_bound_itself():
    a = np.array([[19.0, 0, 0, 0], [3.0, 4, 0, 0], [1.0, 0, 0, 0]])
    b = np.array([[19.0, 6, 1, np.sqrt(2)], [4.0, 3, 0, 0], [95.0, 0, 0, np.sqrt(100**2 - 95**2)]])
    near = crosspoly.cosines(a, b, 0.96)
    assert near[1, 1] and not near[0, 0] and not near[2, 2]
    assert (crosspoly.cosines(a, b, 0.96) == crosspoly.cosines(b, a, 0.96).T).all()


@pytest.mark.parametrize("n,dim", [(1000, 64), (10**6, 64), (10**9, 64), (10**6, 768), (10**4, 3)])
def test_pairs_at_the_bound_meet(n, dim):
    hasher = crosspoly.planned(dim, n, 0.95)
    assert hasher.tables * (1 + crosspoly.PROBES) <= crosspoly.MOST_KEYS
    draw = np.random.default_rng(n)
    a, b = draw.normal(size=(2, 500, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= a * (a * b).sum(1, keepdims=True)
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    x, y = hasher.keys(a), hasher.keys(b)
    assert (x[:, :, None] == y[:, None]).any(axis=(1, 2)).all()


def test_transform_is_hadamards():
    x = np.eye(8)
    h = crosspoly.hadamard(x)
    assert np.allclose(h @ h.T, x) and np.allclose(np.abs(h), 1 / math.sqrt(8))


def test_a_bound_without_sense(spark):
    with pytest.raises(ValueError):
        crosspoly.near_vectors(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>"), least=1.0)
