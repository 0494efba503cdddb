"""Near-duplicate vectors: cross-polytope hashing, probed buckets, pairs verified in blocks.

A table turns a vector by ``functions`` pseudo-random rotations, each three times a flip of signs and a fast
Hadamard transform, and takes the nearest corner of the cross-polytope, the greatest coordinate with its
sign, of each. A vector stands in the bucket of these corners and in the PROBES next likely ones, so a
pair meets in a table if any of the buckets of one is one of the other. How many functions: so that the
buckets outnumber the vectors by (1 + PROBES)**2 or more. How many tables: so that a pair at ``least`` itself meets in
none with a chance under MISS, from the share of pairs made at that cosine that meet; nearer pairs miss less. Nothing
but that chance loses a link.

Equal vectors are one class, which is hashed and compared once. Classes whose bucket holds no other end there, and of buckets
that hold the same classes one is enough; the others are dealt, with their vectors, to blocks of about BLOCK within a bucket, and two blocks meet
in one task, which has all cosines between them as one matrix product. A pair that meets in several buckets counts in that of the least key. Out of a
task come, per class, the number of vectors linked, and the edges of a spanning forest: no pairs, and no group whole.

Rows: a vector that is null, empty or zero, or holds null or a non-finite component, links with nothing, and vectors of
different lengths do not link; repeated rows are vectors of their own and so link; a null id is never a component's
unless all ids there are null, and then the component is null; an empty table gives none.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._shared import discard, materialize
from ._words import mix64

LEAST = 0.95
PROBES, MISS = 4, 1e-5
#: Rows of a bucket key that a vector has at most: tables times 1 + PROBES. Fewer functions, so fuller buckets, where more would be needed.
MOST_KEYS = 80
BLOCK = 512
SEED = 13
_NEXT = 3  # further corners of one rotation that a probe may take
_BATCH = 2048
_U = np.uint64


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast transform along the first axis, whose length is a power of two; norms stay."""
    size, h = len(x), 1
    while h < size:
        halves = x.reshape(size // (2 * h), 2, h, -1)
        x = np.stack((halves[:, 0] + halves[:, 1], halves[:, 0] - halves[:, 1]), axis=1).reshape(size, -1)
        h *= 2
    return x / np.sqrt(x.dtype.type(size))


class Hasher:
    """Bucket keys of unit vectors of one length."""

    def __init__(self, dim: int, tables: int, n_functions: int):
        self.dim, self.tables, self.n_functions = dim, tables, n_functions
        self.size = max(32, 1 << (dim - 1).bit_length())
        draw = np.random.default_rng([SEED, dim])
        self.signs = draw.choice(np.array([-1, 1], np.float32), size=(tables, n_functions, 3, self.size, 1))
        # what a probe changes: one function to its first, second or third next corner, or two of them to the first
        one = [[(f, r)] for f in range(n_functions) for r in range(1, _NEXT + 1)]
        self.changes = [[], *one, *([(f, 1), (g, 1)] for f in range(n_functions) for g in range(f))]

    def _corners(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(1 + _NEXT, n) codes of the nearest corners, and how much further off than the nearest they are."""
        long = np.abs(x)
        at = np.argpartition(long, len(x) - 1 - _NEXT, axis=0)[-1 - _NEXT :]
        there = np.take_along_axis(long, at, 0)
        order = np.argsort(-there, axis=0, kind="stable")
        at, there = np.take_along_axis(at, order, 0), np.take_along_axis(there, order, 0)
        return 2 * at + (np.take_along_axis(x, at, 0) > 0), (there[0] - there) ** 2

    def table(self, t: int, unit: np.ndarray) -> np.ndarray:
        """(1 + PROBES, n) keys of table t."""
        padded, near = np.zeros((self.size, len(unit)), np.float32), []
        padded[: self.dim] = unit.T
        for flips in self.signs[t]:
            x = padded
            for flip in flips:
                x = hadamard(x * flip)
            near.append(self._corners(x))
        cost = np.stack([sum((near[f][1][r] for f, r in change), np.zeros(len(unit), np.float32)) for change in self.changes])
        best = np.argsort(cost, axis=0, kind="stable")[: 1 + PROBES]
        rank = np.zeros((len(self.changes), self.n_functions), np.int64)
        for i, change in enumerate(self.changes):
            for f, r in change:
                rank[i, f] = r
        key = np.broadcast_to(mix64(np.array([self.dim << 20 | t], np.uint64)), best.shape)
        for f in range(self.n_functions):
            key = mix64(key + np.take_along_axis(near[f][0], rank[best, f], 0).astype(np.uint64) + _U(1))
        return key

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """(n, tables * (1 + PROBES)) keys."""
        return np.concatenate([self.table(t, unit) for t in range(self.tables)]).T


def _meets(dim: int, n_functions: int, least: float, pairs: int = 1500, tables: int = 8) -> float:
    """Share of pairs of that cosine that meet in a table, three standard errors below what was seen."""
    draw = np.random.default_rng([SEED, dim, n_functions])
    a, b = draw.normal(size=(2, pairs, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= a * (a * b).sum(1, keepdims=True)
    b *= np.sqrt(1 - least**2) / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
    b += least * a
    hasher, met = Hasher(dim, tables, n_functions), 0
    for t in range(tables):
        x, y = hasher.table(t, a), hasher.table(t, b)
        met += int((x[:, None] == y).any(axis=(0, 1)).sum())
    seen = met / (pairs * tables)
    return max(1e-3, min(1 - 1e-9, seen - 3 * math.sqrt(seen * (1 - seen) / (pairs * tables))))


@functools.lru_cache(maxsize=64)
def planned(dim: int, n: int, least: float) -> Hasher:
    """The hasher for n vectors: as many functions as n wants, or as MOST_KEYS allows; tables by MISS."""
    size = max(32, 1 << (dim - 1).bit_length())
    wanted = max(1, math.ceil(math.log((1 + PROBES) ** 2 * max(n, 2)) / math.log(2 * size)))
    for n_functions in range(wanted, 0, -1):
        tables = math.ceil(math.log(MISS) / math.log1p(-_meets(dim, n_functions, least)))
        if tables * (1 + PROBES) <= MOST_KEYS or n_functions == 1:
            return Hasher(dim, tables, n_functions)
    raise AssertionError


def _clean(values: pa.Array) -> Iterator[np.ndarray | None]:
    """Each vector in doubles, -0 as 0; None for one that links with nothing."""
    flat, known = values.values.cast(pa.float64()), values.is_valid().to_pylist()
    bad = np.asarray(flat.is_null()) | ~np.isfinite(flat.fill_null(0).to_numpy(zero_copy_only=False))
    plain = flat.fill_null(0).to_numpy(zero_copy_only=False) + 0.0
    for i, (lo, hi) in enumerate(zip(values.offsets[:-1].to_pylist(), values.offsets[1:].to_pylist(), strict=True)):
        v = plain[lo:hi]
        yield v if known[i] and not bad[lo:hi].any() and v.any() else None


def _unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in doubles, scaled by powers of two, so that no square leaves their range, and their lengths."""
    vectors = vectors.astype(np.float64, copy=False)
    scaled = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])
    return scaled, np.sqrt((scaled * scaled).sum(axis=1))


def _lists(rows: np.ndarray) -> pa.Array:
    n, m = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * m + 1, m, dtype=np.int32)), pa.array(np.ascontiguousarray(rows).reshape(-1)))


def _rows(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, digest, v): both null for a vector that links with nothing; floats stay floats, all else comes in doubles."""
    kind = df.schema[id_col].dataType.simpleString()
    item = "float" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    values = pa.float32() if item == "float" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(_clean(b.column(1)))
            digests = [None if v is None else hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(found, pa.list_(values))], ["id", "digest", "v"])

    return df.select(F.col(id_col).alias("id"), F.col(vector_col).cast(f"array<{item}>").alias("v")).mapInArrow(run, f"id {kind}, digest binary, v array<{item}>")


def _hashed(classes: DataFrame, n: int, least: float) -> DataFrame:
    """(cid, v, keys) of (cid, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (batch.slice(at, _BATCH) for batch in batches for at in range(0, batch.num_rows, _BATCH)):
            sizes = np.diff(b.column(1).offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                part = b.take(pa.array(np.flatnonzero(sizes == dim)))
                vectors, lengths = _unit(part.column(1).flatten().to_numpy().reshape(-1, dim))
                keys = planned(dim, n, least).keys(vectors / lengths[:, None])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _lists(keys.view(np.int64))], ["cid", "v", "keys"])

    return classes.mapInArrow(run, f"cid long, v {classes.schema['v'].dataType.simpleString()}, keys array<long>")


def cosines(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which pairs have a cosine of ``least`` or more, in doubles; next to it by sums without rounding, whatever the order."""
    (x, nx), (y, ny) = _unit(a), _unit(b)
    found = (x @ y.T) / (nx[:, None] * ny)
    near = found >= least
    for i, j in zip(*np.nonzero(np.abs(found - least) < 1e-12), strict=True):
        length = math.sqrt(math.fsum(x[i] * x[i])) * math.sqrt(math.fsum(y[j] * y[j]))
        near[i, j] = math.fsum(x[i] * y[j]) / length >= least
    return near


def _met_before(key: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs share a key below ``key`` too: as a product of which rows have which keys."""
    shared = np.intersect1d(a, b)
    shared = shared[shared < key]
    if not len(shared):
        return np.zeros((len(a), len(b)), bool)

    def has(keys: np.ndarray) -> np.ndarray:
        out = np.zeros((len(keys), len(shared)), np.float32)
        at = np.minimum(np.searchsorted(shared, keys), len(shared) - 1)
        row, col = np.nonzero(shared[at] == keys)
        out[row, at[row, col]] = 1
        return out

    return has(a) @ has(b).T > 0.5


def _forest(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges between ids of a spanning forest of the marked pairs."""
    nodes, place = np.unique(np.concatenate((left, right)), return_inverse=True)
    label, of_right = np.arange(len(nodes)), place[len(left) :]
    for i in np.flatnonzero(near.any(axis=1)).tolist():
        other = of_right[near[i]]
        for was, j in zip(*np.unique(label[other], return_index=True), strict=True):
            mine = label[place[i]]
            if was != mine:
                yield int(left[i]), int(nodes[other[j]])
                label[label == was] = mine


def _compared(key: int, one: tuple, two: tuple, least: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Ids, the weight linked to each, and a forest, of blocks (ids, weights, vectors, keys) against one another, or of one in itself."""
    near = cosines(one[2], two[2], least) & ~_met_before(key, one[3], two[3])
    if one is two:
        np.fill_diagonal(near, False)
        return one[0], near @ one[1], list(_forest(np.triu(near), one[0], one[0]))
    return np.concatenate((one[0], two[0])), np.concatenate((near @ two[1], near.T @ one[1])), list(_forest(near, one[0], two[0]))


#: Buckets of so few are compared pair by pair, those of a batch together.
_FEW = 12


def _pairs_linked(key: np.ndarray, vectors: np.ndarray, keys: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the linked pairs within groups of _FEW rows at most, those left out that share a lesser key."""
    a, b = [], []
    for size in np.unique(sizes).tolist():
        i, j = np.triu_indices(size, 1)
        at = starts[sizes == size][:, None]
        a.append((at + i).ravel())
        b.append((at + j).ravel())
    a, b, (x, n) = np.concatenate(a), np.concatenate(b), _unit(vectors)
    found = np.concatenate([np.einsum("ij,ij->i", x[a[lo : lo + _BATCH]], x[b[lo : lo + _BATCH]]) / (n[a[lo : lo + _BATCH]] * n[b[lo : lo + _BATCH]]) for lo in range(0, len(a), _BATCH)])
    near = found >= least
    for i in np.flatnonzero(np.abs(found - least) < 1e-12).tolist():
        near[i] = cosines(vectors[a[i : i + 1]], vectors[b[i : i + 1]], least)[0, 0]
    a, b = a[near], b[near]
    first = np.zeros(len(a), bool)
    for lo in range(0, len(a), _BATCH):
        p, q = keys[a[lo : lo + _BATCH]], keys[b[lo : lo + _BATCH]]
        lesser = (p[:, :, None] == q[:, None]) & (p < key[a[lo : lo + _BATCH], None])[:, :, None]
        first[lo : lo + len(p)] = ~lesser.any(axis=(1, 2))
    return a[first], b[first]


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(cuts, columns) for batches of (key, x, y, side, cid, w, v, keys): whole groups of one key, x, y and length of v, a group
    from one cut to the next; vectors and keys as matrices."""

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy().reshape(len(column), -1)

    held: list[np.ndarray] | None = None
    for b in (batch.slice(lo, _BATCH) for batch in batches for lo in range(0, batch.num_rows, _BATCH)):
        length = np.diff(b.column(6).offsets.to_numpy())
        ends = [*(np.flatnonzero(length[1:] != length[:-1]) + 1).tolist(), len(length)]
        for lo, hi in zip([0, *ends], ends):
            part = b.slice(lo, hi - lo)
            columns = [*(part.column(k).to_numpy() for k in range(6)), matrix(part.column(6)), matrix(part.column(7))]
            if held is not None and held[6].shape[1] == columns[6].shape[1]:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            elif held is not None:
                yield np.array([0, len(held[0])]), held
            change = np.zeros(len(columns[0]), bool)
            for k in range(3):
                change[1:] |= columns[k][1:] != columns[k][:-1]
            cuts = np.concatenate(([0], np.flatnonzero(change)))  # the last group may go on
            held = [x[cuts[-1] :] for x in columns]
            if len(cuts) > 1:
                yield cuts, [x[: cuts[-1]] for x in columns]
    if held is not None:
        yield np.array([0, len(held[0])]), held


def _in_blocks(members: DataFrame, least: float) -> DataFrame:
    """(u, v, w) of (key, x, y, side, cid, w, v, keys): what is linked to u weighs w more; u and v, if not null, are connected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(u: np.ndarray, v: np.ndarray | None, w: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.nulls(len(u), pa.int64()) if v is None else pa.array(v, pa.int64()), pa.array(w, pa.int64())], ["u", "v", "w"])

        for cuts, (key, _, _, side, cid, w, vectors, keys) in _whole_groups(batches):
            starts, sizes = cuts[:-1], np.diff(cuts)
            few = (sizes > 1) & (sizes <= _FEW) & (side[starts] == 2)
            if few.any():
                a, b = _pairs_linked(key, vectors, keys, starts[few], sizes[few], least)
                yield out(np.concatenate((cid[a], cid[b])), np.concatenate((cid[b], cid[a])), np.concatenate((w[b], w[a])))
            for lo, n in zip(starts[~few].tolist(), sizes[~few].tolist(), strict=True):
                of = [[x[lo : lo + n][side[lo : lo + n] == s] for x in (cid, w, vectors, keys)] for s in range(3)]
                one, two = (of[2], of[2]) if len(of[2][0]) else (of[0], of[1])
                if len(one[0]) and len(two[0]):
                    ids, weight, edges = _compared(int(key[lo]), one, two, least)
                    yield out(ids, None, weight)
                    yield out(np.array([e[0] for e in edges], np.int64), np.array([e[1] for e in edges], np.int64), np.zeros(len(edges), np.int64))

    order = ("key", "x", "y", "dim")
    dealt = members.withColumn("dim", F.size("v")).repartition("key", "x", "y").sortWithinPartitions(*order).select("key", "x", "y", "side", "cid", "w", "v", "keys")
    return dealt.mapInArrow(run, "u long, v long, w long")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST) -> DataFrame:
    """(id, n_links, component_id): one row per row; how many other vectors have a cosine of ``least`` (over 0, below 1) or
    more with this one, and the smallest id reachable by such links."""
    if not 0 < least < 1:
        raise ValueError("least must be between 0 and 1")
    rows = materialize(_rows(df, id_col, vector_col), "vectors")
    classes = rows.where("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("w"), F.min("id").alias("first_id"), F.first("v").alias("v"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    # twice the rows at most from one power of two to the next, so that a few rows more rarely change the keys
    hashed = materialize(_hashed(classes.select("cid", "v"), 1 << rows.count().bit_length(), least), "vector-keys")

    keyed = hashed.select("cid", F.explode("keys").alias("key"))
    # of buckets that hold the same, by two hashes of 64 bits over them, the one of least key has all the pairs' least keys
    held = [F.bit_xor(F.xxhash64("cid", F.lit(k))).alias(f"h{k}") for k in (1, 2)]
    filled = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *held).where("n > 1").groupBy("n", "h1", "h2").agg(F.min("key").alias("key"))
    met = materialize(filled.select("key", F.ceil(F.col("n") / F.lit(float(BLOCK))).cast("int").alias("blocks")), "vector-buckets")
    own = F.pmod(F.xxhash64("cid"), F.col("blocks").cast("long")).cast("int")
    member = materialize(keyed.join(met, "key").select("key", "cid", own.alias("own"), "blocks"), "vector-members")
    full = member.join(hashed.join(classes.select("cid", "w"), "cid"), "cid")
    dealt = full.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"x": F.least("own", "o"), "y": F.greatest("own", "o")})
    side = F.when(F.col("own") < F.col("o"), 0).when(F.col("own") > F.col("o"), 1).otherwise(2)
    found = materialize(_in_blocks(dealt.withColumn("side", side), least), "vector-links")

    linked = found.where("w > 0").groupBy(F.col("u").alias("cid")).agg(F.sum("w").alias("linked"))
    roots = components(found.where("v is not null").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    named = classes.select("cid", "digest", "w", "first_id").join(linked, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    n_links = F.col("w") - 1 + F.coalesce("linked", F.lit(0))
    named = materialize(named.select("digest", "first_id", F.coalesce("root", "cid").alias("root"), n_links.alias("n_links")), "vector-roots")
    smallest = materialize(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "vector-smallest")
    by_class = materialize(named.join(smallest, "root").select("digest", "n_links", "component_id"), "vector-components")
    for done in (classes, hashed, met, member, found, named, smallest):
        discard(done)
    alone = rows.where("digest is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return rows.where("digest is not null").select("id", "digest").join(by_class, "digest").select("id", "n_links", "component_id").unionByName(alone)
