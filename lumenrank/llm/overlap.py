"""Pairs of texts whose sets of word shingles are alike: found by MinHash bands, decided exactly.

A pair of Jaccard similarity j shares a band of ``WIDE`` least hashes with chance j**WIDE, so none of
``BANDS`` with (1 - j**WIDE)**BANDS: 0.000007 at 0.8, less above. Bands only name candidates; whether
a pair is linked is counted from the two sets of 64-bit shingle hashes.

Texts of one set are one class and meet once. Of a band's key, the members of other components meet
its least member first. Keys that still have several components after that are compared in blocks: the
members of the greatest of them are dealt to blocks of about BLOCK, and so are the others; a block of the
former meets a block of the latter in one task, which holds the two, counts all their overlaps and sends
only links on. Members of one component never meet, and no pairs are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._shared import discard, materialize
from ._words import hashed_words, mix64, powers, texts_of

WORDS = 5
WIDE, BANDS = 5, 30
BLOCK = 256
_U = np.uint64
_BASE = 0xD6E8FEB86659FD93
_SALTS, _SCALES = mix64(np.arange(1, 2 * WIDE * BANDS + 1, dtype=np.uint64)).reshape(2, -1)
_SCALES = _SCALES | _U(1)


def _shingles(h: np.ndarray, size: int) -> np.ndarray:
    """The different hashes of ``size`` consecutive words, ascending; a shorter text is one shingle."""
    n = min(size, len(h))
    if not n:
        return np.zeros(1, np.uint64)
    up, down = powers(_BASE, len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return np.unique(mix64((total[n:] - total[: len(h) - n + 1]) * down[: len(h) - n + 1] + _U(n)))


def shingle_sets(texts: list[bytes], ignore: bytes = b"", size: int = WORDS) -> Iterator[np.ndarray]:
    for i, j, h, bounds in hashed_words([t.lower().translate(None, ignore) for t in texts]):
        for k in range(j - i):
            yield _shingles(h[0, bounds[k] : bounds[k + 1]], size)


def set_hash(s: np.ndarray) -> int:
    return int(mix64(s + _U(1)).sum(dtype=np.uint64).view(np.int64))


def band_keys(s: np.ndarray) -> np.ndarray:
    least = np.full(WIDE * BANDS, ~_U(0))
    for at in range(0, len(s), 1024):
        np.minimum(least, (s[at : at + 1024] * _SCALES[:, None] + _SALTS[:, None]).min(axis=1), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, WIDE).T:
        key = mix64(key * _U(_BASE) + column)
    return key.view(np.int64)


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, ignore: bytes) -> DataFrame:
    """(s, hashes) of the classes in ``wanted(id, s)``, read from one text of each."""
    ids = wanted.groupBy("s").agg(F.min(F.struct("id")).alias("i")).select(F.col("i.id").alias("wanted_id")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                found = list(shingle_sets(texts_of(b.column(0).slice(at, 256)), ignore))
                yield pa.RecordBatch.from_arrays([pa.array([set_hash(s) for s in found], pa.int64()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["s", "hashes"])

    texts = docs.join(ids, docs[id_col].eqNullSafe(ids["wanted_id"]), "left_semi").select(text_col)
    return materialize(texts.mapInArrow(run, "s long, hashes array<long>").dropDuplicates(["s"]), "overlap-sets")


def _decided(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(u, v): roots of the pairs (s, root, other, other_root) that are alike."""
    with_sets = pairs.join(sets, "s").join(sets.select(F.col("s").alias("other"), F.col("hashes").alias("other_hashes")), "other")
    both, total = F.size(F.array_intersect("hashes", "other_hashes")), F.size("hashes") + F.size("other_hashes")
    return with_sets.where(both + 1e-9 >= F.lit(least) * (total - both)).select(F.col("root").alias("u"), F.col("other_root").alias("v")).distinct()


def _in_blocks(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(u, v): roots of members (key, s, n, root) of one key and different roots that are alike."""
    sizes = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    keys = sizes.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("major"), F.max("c").alias("m"), (F.sum("c") - F.max("c")).alias("u"))
    blocks = lambda c: F.ceil(F.col(c) / F.lit(float(BLOCK))).cast("int")
    keys = materialize(keys.select("key", "major", blocks("m").alias("mb"), blocks("u").alias("ub")), "overlap-keys")
    dealt = members.join(keys, "key").withColumn("of_major", F.col("root") == F.col("major"))
    own = lambda n: F.pmod(F.xxhash64("s"), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    major = dealt.where("of_major").select("key", "s", "root", own("mb").alias("a"), every("ub").alias("b"), F.lit(0).alias("side"))
    minor = dealt.where("not of_major").select("key", "s", "root", every("mb").alias("a"), own("ub").alias("b"), F.lit(1).alias("side"))
    # the others among themselves: each pair of blocks once, marked by a below zero
    two = dealt.where("not of_major").select("key", "s", "root", own("ub").alias("x"), every("ub").alias("y"))
    two = two.select("key", "s", "root", (-F.least("x", "y") - 1).alias("a"), F.greatest("x", "y").alias("b"), F.when(F.col("x") < F.col("y"), 0).when(F.col("x") > F.col("y"), 1).otherwise(2).alias("side"))
    rows = major.unionByName(minor).unionByName(two).join(sets, "s")
    kind = members.schema["root"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(group: list[tuple[int, int, np.ndarray]]) -> Iterator[tuple[int, int]]:
            left = [x for x in group if x[0] != 1]
            if not left:
                return
            size = np.array([len(x[2]) for x in left])
            owner, values = np.repeat(np.arange(len(left)), size), np.concatenate([x[2] for x in left])
            order = np.argsort(values, kind="stable")
            owner, values = owner[order], values[order]
            roots, seen = np.array([x[1] for x in left]), set()
            for side, root, h in group:
                if side == 0:
                    continue
                lo, hi = np.searchsorted(values, h, "left"), np.searchsorted(values, h, "right")
                n = hi - lo
                at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(left))
                near = both + 1e-9 >= least * (size + len(h) - both)
                for other in np.unique(roots[near & (roots != root)]).tolist():
                    if (root, other) not in seen:
                        seen |= {(root, other), (other, root)}
                        yield root, other

        def sent(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in pairs], pa.int64()), pa.array([v for _, v in pairs], pa.int64())], ["u", "v"])

        at, group = None, []
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                keys_, a_, b_, side, root = (part.column(k).to_pylist() for k in range(5))
                lists = part.column(5)
                for i in range(part.num_rows):
                    here = (keys_[i], a_[i], b_[i])
                    if here != at:
                        if group:
                            yield sent(list(linked(group)))
                        at, group = here, []
                    group.append((side[i], root[i], lists[i].values.to_numpy().view(np.uint64)))
        if group:
            yield sent(list(linked(group)))

    grouped = rows.select("key", "a", "b", "side", "root", "hashes").repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return grouped.mapInArrow(run, f"u {kind}, v {kind}").distinct()


def links(docs: DataFrame, prints: DataFrame, known: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text", ignore: bytes = b"") -> DataFrame:
    """(u, v): links whose components are those of ``known`` and of texts alike at ``least`` or more.

    ``prints`` is (id, fp, s, n, keys): a text's fingerprint, set hash, set size and band keys.
    Texts of one set must have one fingerprint.
    """
    classes = prints.groupBy("s").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    met = classes.select("s", "fp", "n", F.explode("keys").alias("key"))
    shared = met.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key")
    members = materialize(met.join(shared, "key", "left_semi"), "overlap-members")
    near = (F.least("n", "other_n") + 1e-9) >= F.greatest("n", "other_n") * F.lit(least)

    def labelled(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        """One edge a node to its root, and the members of keys that have several roots."""
        roots = materialize(components(edges), "overlap-roots")
        out = members.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        split = out.groupBy("key").agg(F.min(F.struct("root", "s", "n")).alias("low"), F.max("root").alias("top")).where("low.root < top")
        return roots.select(F.col("node").alias("u"), F.col("root").alias("v")), materialize(out.join(split.select("key", "low"), "key"), "overlap-split")

    now, split = labelled(known)
    sets = _sets(docs, prints.join(split.select("s").distinct(), "s", "left_semi"), id_col, text_col, ignore)
    stars = split.where("root <> low.root").select("s", "n", "root", F.col("low.s").alias("other"), F.col("low.n").alias("other_n"), F.col("low.root").alias("other_root")).where(near)
    now, rest = labelled(now.unionByName(_decided(stars.select("s", "root", "other", "other_root").distinct(), sets, least)))
    found = materialize(_in_blocks(rest.select("key", "s", "n", "root"), sets, least), "overlap-found")
    out = materialize(now.unionByName(found), "overlap-links")
    for done in (members, sets):
        discard(done)
    return out
