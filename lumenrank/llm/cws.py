"""Document fingerprints by consistent weighted sampling.

For each sample k and each term with weight w, from hashes of (term, k): r and c with a
Gamma(2, 1) distribution, beta uniform; t = floor(ln w / r + beta), ln a = ln c - r (t - beta)
- r. The sample of a document is the (term, t) of least a. Two documents have the same sample
with a probability equal to their generalised Jaccard similarity, sum of least weights over sum
of greatest. Terms are words `[^\\x20\\x09-\\x0D]+`, weights their counts.

Rows: null text counts as empty; a text without words has the all-zero fingerprint, alike only
to another such; equal texts have equal fingerprints; rows repeating an id follow one another by text, a null id comes first; a
long text is one value; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import listed, partition_keys, range_bounds, range_of, width
from ._words import hashed_words, mix64

SAMPLES = 64
_SLOTS = 1 << 15
_BLOCK = 1 << 13
_U = np.uint64


class Sampler:
    """Fingerprints of word counts. What frequent terms draw is kept in a table of fixed size."""

    def __init__(self, samples: int = SAMPLES, seed: int = 7):
        self.keys = mix64(np.arange(1, 2 * samples + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed)).reshape(2, samples)
        self.tags = np.zeros(_SLOTS, np.uint64)
        self.one = np.zeros((_SLOTS, samples), np.float32)
        self.samples = samples

    def _draws(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """r, ln c and beta of shape (terms, samples)."""
        x, y = (mix64(terms[:, None] + k[None, :]) for k in self.keys)
        unit = lambda v, s: (((v >> _U(s)) & _U(0xFFFFFF)).astype(np.float32) + np.float32(0.5)) / np.float32(1 << 24)
        r = -np.log(unit(x, 40) * unit(x, 16))
        c = np.log(-np.log(unit(y, 40) * unit(y, 16)))
        beta = (((x & _U(0xFFF)) << _U(12) | y & _U(0xFFF)).astype(np.float32) + np.float32(0.5)) / np.float32(1 << 24)
        return r, c, beta

    def _alone(self, terms: np.ndarray) -> np.ndarray:
        """ln a of terms of weight 1, for which t is 0."""
        r, c, beta = self._draws(terms)
        return c + r * beta - r

    def _values(self, terms: np.ndarray) -> np.ndarray:
        slots = (terms & _U(_SLOTS - 1)).astype(np.int64)
        new = np.flatnonzero(self.tags[slots] != terms)
        if not len(new):
            return self.one[slots]
        fresh = self._alone(terms[new])
        out = self.one[slots]  # before others take their slots
        out[new] = fresh
        self.tags[slots[new]], self.one[slots[new]] = terms[new], fresh
        return out

    def fingerprint(self, words: np.ndarray) -> np.ndarray:
        """32-bit codes from the hashes of a text's words, repeats included."""
        if not len(words):
            return np.zeros(self.samples, np.uint32)
        terms, counts = np.unique(words, return_counts=True)
        many = counts > 1
        best = np.full(self.samples, np.inf, np.float32)
        code = np.zeros(self.samples, np.uint64)
        for group, weighted in ((terms[~many], None), (terms[many], np.log(counts[many]).astype(np.float32))):
            for at in range(0, len(group), _BLOCK):
                part = group[at : at + _BLOCK]
                if weighted is None:
                    a, t = self._values(part), None
                else:
                    r, c, beta = self._draws(part)
                    t = np.floor(weighted[at : at + _BLOCK, None] / r + beta)
                    a = c - r * (t - beta) - r
                who = a.argmin(axis=0)
                here = a[who, np.arange(self.samples)]
                level = np.zeros(self.samples, np.uint64) if t is None else t[who, np.arange(self.samples)].astype(np.uint64)
                less = here < best
                best[less], code[less] = here[less], mix64(part[who] + level * _U(0xD6E8FEB86659FD93))[less]
        return (code >> _U(32)).astype(np.uint32) | np.uint32(1)  # never the code of a text without words


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprints(texts: list[bytes], sampler: Sampler) -> list[np.ndarray]:
    out = []
    for lo, hi, h, bounds in hashed_words(texts):
        out += [sampler.fingerprint(h[0, bounds[i] : bounds[i + 1]]) for i in range(hi - lo)]
    return out


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(id, fingerprint): the codes of each text as hexadecimal digits."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        for b in batches:
            found = fingerprints([(t or "").encode() for t in b.column(1).to_pylist()], sampler)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_hex(x) for x in found])], ["id", "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, fingerprint string")


def _hex(codes: np.ndarray) -> str:
    return codes.astype(">u4").tobytes().hex()


def in_order_with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(part, halo, id, text), sorted in partitions: each part holds a range of ids in order and
    then, as halo, the first row after it (after the last part: the first of all)."""
    spark = docs.sparkSession
    n = width(spark)
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    bounds = range_bounds(named.where("id is not null").select("id"), "id", n)
    named = named.withColumn("part", range_of(F.col("id"), bounds))
    # one row a range, of which there are as many as shuffle partitions at most; null comes first
    first = {r.part: (None if r.nulls else r.low) for r in named.groupBy("part").agg(F.min("id").alias("low"), F.count_if(F.col("id").isNull()).alias("nulls")).collect()}
    order = sorted(first)
    before = {p: order[i - 1] for i, p in enumerate(order)}
    ranges = range(len(bounds) + 1)
    at = (F.col("part") + 1).cast("int")
    starts = F.col("id").eqNullSafe(F.element_at(listed([first.get(p) for p in ranges]), at))
    edge = F.when(starts, F.element_at(listed([before.get(p) for p in ranges]), at).cast("int"))
    places = F.array_compact(F.array(F.struct(F.col("part"), F.lit(0).alias("halo")), F.when(F.col("edge").isNotNull(), F.struct(F.col("edge").alias("part"), F.lit(1).alias("halo")))))
    placed = named.withColumn("edge", edge).withColumn("place", F.explode(places)).select("place.part", "place.halo", "id", "text")
    key = F.element_at(listed(partition_keys(spark, n)), (F.col("part") + 1).cast("int"))
    return placed.withColumn("key", key).repartition(n, "key").sortWithinPartitions("part", "halo", "id", "text").select("part", "halo", "id", "text")


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Each document beside an edit of it: the last half of its code points gives way to the
    first as many (or all) of the next document. Rows repeating an id follow one another by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)

        def rows() -> Iterator[tuple]:
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    yield from zip(*(c.to_pylist() for c in b.slice(at, 256).columns), strict=True)

        def pairs() -> Iterator[tuple[int | None, str, str]]:
            held, done = None, None
            for part, halo, i, t in rows():
                if halo:
                    if part != done and held is not None:
                        yield held[1], held[2], t
                    held, done = None, part
                else:
                    if held is not None and held[0] == part:
                        yield held[1], held[2], t
                    held = (part, i, t)

        def block(items: list[tuple]) -> pa.RecordBatch:
            edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for _, t, after in items]
            chain = [t for _, t, _ in items]
            # where one item's next is the item after it, its fingerprint serves both
            lone = [k for k, (_, _, after) in enumerate(items) if k + 1 == len(items) or items[k + 1][1] != after]
            raw = [x.encode() for x in (*chain, *edited, *(items[k][2] for k in lone))]
            got = fingerprints(raw, sampler)
            n = len(items)
            own, cut, rest = got[:n], got[n : 2 * n], dict(zip(lone, got[2 * n :], strict=True))
            following = [rest[k] if k in rest else own[k + 1] for k in range(n)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in items], pa.int64()),
                    pa.array([len(t) for t in chain], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in raw[n : 2 * n]]),
                    pa.array([_hex(x) for x in own]),
                    pa.array([_hex(x) for x in cut]),
                    pa.array([likeness(a, b) for a, b in zip(own, cut, strict=True)]),
                    pa.array([likeness(a, b) for a, b in zip(own, following, strict=True)]),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        items: list[tuple] = []
        total = 0
        for item in pairs():
            items.append(item)
            total += len(item[1])
            if total > 1 << 20 or len(items) >= 1000:
                yield block(items)
                items, total = [], 0
        if items:
            yield block(items)

    return in_order_with_next(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
