"""SimHash near-duplicates by covering locality-sensitive hashing.

A pair of 64-bit fingerprints within ``radius`` bits collides in at least one of the
2**(radius+1)-1 tables: every bit position i has a vector m(i) of radius+1 bits, and table v
keeps the positions whose product <m(i), v> is odd. At most ``radius`` differing positions
span less than the whole space, so some v is orthogonal to all of them and keeps none.

Fingerprints that meet another one in a table go on to an exact check without pairs: two
fingerprints are within 2 bits exactly if the balls of radius 1 around them share a point.
Each candidate is sent to its 65 ball points, so the work is linear in the candidates however
many of them are alike, and a point gathers at most 65 different fingerprints.

For a greater radius the fingerprints of a table's key are compared in the task that has them,
all with all but one at a time, and only the links of a spanning forest leave it. A key has half
the bits of a fingerprint, so even near copies of one text scatter over the keys; memory is that
of a key's different fingerprints, time the square of their number.

Rows: null text counts as empty; a text without words has fingerprint zero and is linked like
any other; repeated rows share a fingerprint and so a component; a null id is a component's only if all ids there are null; an
empty table gives none.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import overlap
from ._graph import components
from ._shared import discard, materialize
from ._words import texts_of

SEED = 42
BITS = 64
_RUN = 1 << 16


PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def fingerprint(text: bytes, shingle_words: int = 3, distinct: bool = False, ignore: bytes = b"") -> int:
    """64-bit SimHash, unsigned: a bit is one if set in over half the shingle hashes.

    ``distinct`` counts each shingle once; the bytes of ``ignore`` are left out of the text.
    """
    words = text.lower().translate(None, ignore).split()  # of bytes: A-Z only, and exactly the six ASCII white spaces
    n = len(words) - shingle_words + 1
    if not words:
        return 0
    if n <= 1:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    counts, total = np.zeros(BITS, np.int64), 0
    seen: set[bytes] = set()
    for at in range(0, n, _RUN):
        run = words[at : min(at + _RUN, n) + shingle_words - 1]
        hashes = [xxhash.xxh64_digest(g, SEED) for g in map(b" ".join, zip(*(run[i:] for i in range(shingle_words))))]
        if distinct:
            hashes = list(set(hashes) - seen)
            seen.update(hashes)
        total += len(hashes)
        counts += np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, distinct: bool = False, ignore: bytes = b"") -> DataFrame:
    """(id, fp): one row per input row, fp a long with the fingerprint's 64 bits."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, shingle_words, distinct, ignore) for t in texts_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind.simpleString()}, fp long")


def masks(radius: int, bits: int = BITS) -> list[int]:
    """The covering masks as unsigned numbers, each of about half of the positions.

    Positions are dealt evenly over the non-zero vectors. Where there are fewer positions than vectors, a part in order
    would leave a mask of one bit; then they are drawn, but for radius 6: the vectors of odd first place make a
    Reed-Muller code, whose masks have 32 bits and one all 64.
    """
    space = 1 << (radius + 1)
    if bits >= space - 1:
        vector = [1 + i % (space - 1) for i in range(bits)]
    elif 2 * bits == space:
        vector = list(range(bits, space))
    else:
        vector = random.Random(SEED).sample(range(1, space), bits)
    return [sum(1 << i for i in range(bits) if bin(vector[i] & v).count("1") % 2) for v in range(1, space)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(fps: DataFrame, radius: int) -> DataFrame:
    """(fp, t, key): the kept bits of each fingerprint in each table."""
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(_signed(m)).alias("m")) for i, m in enumerate(masks(radius))])
    return fps.select("fp", F.explode(tables).alias("k")).select("fp", "k.t", F.col("fp").bitwiseAND(F.col("k.m")).alias("key"))


def candidates(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(fp): those of the distinct fingerprints that share a table's key with another one."""
    keyed = _keyed(fps, radius)
    met = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # written, so that a key of many fingerprints can be split in the join
    return keyed.join(materialize(met, "simhash-keys"), ["t", "key"], "left_semi").select("fp").distinct()


def _forest(g: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the different fingerprints within the radius of one another."""
    label, out = np.arange(len(g)), []
    for i in range(len(g) - 1):
        near = np.flatnonzero(np.bitwise_count(g[i + 1 :] ^ g[i]) <= radius) + i + 1
        near = near[label[near] != label[i]]
        for other, j in zip(*np.unique(label[near], return_index=True), strict=True):
            out.append((i, int(near[j])))
            label[label == other] = label[i]
    return out


def _bucket_links(keyed: DataFrame, radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(t: np.ndarray, key: np.ndarray, fp: np.ndarray, ends: bool) -> tuple[int, pa.RecordBatch]:
            cut = np.concatenate(([0], np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1, [len(t)]))
            if not ends:
                cut = cut[:-1]  # the last key may go on
            size, bits = np.diff(cut), fp.view(np.uint64)
            two = cut[:-1][size == 2]
            near = two[np.bitwise_count(bits[two] ^ bits[two + 1]) <= radius]
            u, v = [fp[near]], [fp[near + 1]]
            for at in np.flatnonzero(size > 2).tolist():
                lo, hi = cut[at], cut[at + 1]
                found = np.array(_forest(bits[lo:hi], radius), np.int64).reshape(-1, 2) + lo
                u.append(fp[found[:, 0]])
                v.append(fp[found[:, 1]])
            return int(cut[-1]), pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

        kept = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for b in batches:
            kept = [np.concatenate((k, c.to_numpy())) for k, c in zip(kept, b.columns, strict=True)]
            done, out = linked(*kept, ends=False)
            kept = [k[done:] for k in kept]
            yield out
        if len(kept[0]):
            yield linked(*kept, ends=True)[1]

    dealt = keyed.repartition("t", "key").sortWithinPartitions("t", "key").select("t", "key", "fp")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v): links whose components are those of all pairs within ``radius`` bits."""
    if radius > 2:
        return _bucket_links(_keyed(fps, radius), radius)
    found = materialize(candidates(fps, radius), "simhash-candidates")
    if radius < 2:  # distance 1: each with its neighbours that exist
        near = found.select(F.col("fp").alias("u"), F.explode(_ball(F.col("fp"))).alias("v")).where("u > v")
        return near.join(found.select(F.col("fp").alias("v")), "v", "left_semi").select("u", "v")
    balls = found.repartition("fp").select("fp", F.explode(_ball(F.col("fp"))).alias("z"))
    low = balls.groupBy("z").agg(F.min("fp").alias("v"), F.max("fp").alias("top")).where("v < top").select("z", "v")
    return balls.join(low, "z").where("fp > v").select(F.col("fp").alias("u"), "v").distinct()


def _ball(fp):
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)).cast("long") for i in range(BITS)])
    return F.transform(flips, lambda m: fp.bitwiseXOR(m))


def with_sketch(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, distinct: bool, ignore: bytes) -> DataFrame:
    """``with_fingerprint`` with what finds overlapping texts: the hash and size of the set of shingles, and its band keys;
    and ``tag``, by which texts of rows repeating an id are told apart: the crc32 of the text, -1 of null."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (batch.slice(at, 512) for batch in batches for at in range(0, batch.num_rows, 512)):
            texts = texts_of(b.column(1))
            fps = [fingerprint(t, shingle_words, distinct, ignore) for t in texts]
            of_set = [(overlap.set_hash(s), len(s), overlap.band_keys(s)) for s in overlap.shingle_sets(texts, ignore)]
            columns = [pa.array([x[0] for x in of_set], pa.int64()), pa.array([x[1] for x in of_set], pa.int32()), pa.array([x[2] for x in of_set], pa.list_(pa.int64()))]
            tags = pa.array([zlib.crc32(t) if known else -1 for t, known in zip(texts, b.column(1).is_valid().to_pylist(), strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), tags, pa.array(np.array(fps, np.uint64).view(np.int64)), *columns], ["id", "tag", "fp", "s", "n", "keys"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind.simpleString()}, tag long, fp long, s long, n int, keys array<long>")


def tag_of(text: Column) -> Column:
    return F.coalesce(F.crc32(text.cast("binary")), F.lit(-1).cast("long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, radius: int = 2, distinct: bool = False, ignore: bytes = b"", least: float | None = None) -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id reachable over links; with ``least`` there is
    a ``tag`` besides, ``tag_of`` the row's text.

    With ``least``, texts whose sets of five-word shingles have that Jaccard similarity are linked
    as well, however far their fingerprints are apart; fingerprints must be of ``distinct`` shingles
    of five words or fewer, which texts of one set have in common.
    """
    tag = [] if least is None else ["tag"]
    if least is None:
        prints = materialize(with_fingerprint(docs, id_col, text_col, shingle_words, distinct, ignore), "simhash-prints")
    elif not distinct or shingle_words > overlap.WORDS:
        raise ValueError("texts of one set of shingles must have one fingerprint")
    else:
        prints = materialize(with_sketch(docs, id_col, text_col, shingle_words, distinct, ignore), "simhash-prints")
    classes = materialize(prints.groupBy("fp").agg(F.min("id").alias("first_id")), "simhash-classes")
    near = links(classes.select("fp"), radius)
    if least is not None:
        near = overlap.links(docs, prints, materialize(near, "simhash-links"), least, id_col, text_col, ignore)
    roots = components(near)
    # the sizes of components differ by orders; minima by component are written to be joined as a table
    named = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = materialize(named, "simhash-named")
    smallest = materialize(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-smallest")
    by_print = materialize(named.join(smallest, "root").select("fp", "component_id"), "simhash-components")
    for done in (classes, named, smallest):
        discard(done)
    return prints.join(by_print, "fp").select("id", *tag, "fp", "component_id")
