"""Phrase mining over documents, pruning of parts of longer phrases, and what headings share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import discard, spread, written
from .clusters import OF, cluster_headings, cluster_pages, cluster_questions, heading_clusters, topics_of


#: Words that a task takes at a time, hashes whose counts and words whose numbers it holds, and bits of the filter at most (16 for each frequent phrase).
PORTION, HELD, KNOWN, MOST_BITS = 1 << 20, 1 << 22, 200_000, 1 << 30
_HASH = (1 << 44) - 1


class Portion:
    """Words of some documents as numbers, one after the other, with the document and the scope of each; a document of any length is whole."""

    def __init__(self, vocabulary: T.Vocabulary, words: list[np.ndarray], scope_of: list[int], scopes: list[tuple], most_words: int = 1):
        # zeros behind, so that a run may be looked for at any place
        self.words = np.concatenate([*words, np.zeros(most_words, np.int32)])
        self.doc = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
        self.scope_of, self.scopes, self.vocabulary = np.array(scope_of, np.int32), scopes, vocabulary
        self.kind, self.key = np.array(vocabulary.kind, np.uint8), np.array(vocabulary.key, np.int32)
        self.of_key = np.array(vocabulary.hashes, np.uint64)
        self.of_scope = np.array([0 if not s or s[0] is None else xxhash.xxh3_64_intdigest(str(s[0]).encode()) for s in scopes], np.uint64)

    def plain(self) -> np.ndarray:
        """Places of the words that a run may hold."""
        return np.flatnonzero(self.kind[self.words[: len(self.doc)]] & 2)

    def runs(self, most_words: int) -> Iterator[tuple[int, np.ndarray]]:
        """(n, places) of the runs of 1 to ``most_words`` of a segment: no number inside, of two letters or more (a single word: three),
        no stop word at either end, and of stop words at most half."""
        kind = self.kind[self.words]
        at = np.flatnonzero(kind[: len(self.doc)] & 3 == 2)
        yield 1, at[kind[at] & 4 > 0]
        stops = np.zeros(len(at), np.int32)
        for n in range(2, most_words + 1):
            last = kind[at + n - 1]
            going = last & 2 > 0
            at, last = at[going], last[going]
            stops = stops[going] + (last & 1)
            yield n, at[(last & 1 == 0) & (stops <= n // 2)]

    def hashes(self, n: int, at: np.ndarray) -> np.ndarray:
        """44 bits of a hash of the scopes and the keys of the runs of n."""
        h = self.of_scope[self.scope_of[self.doc[at]]]
        for i in range(n):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + self.of_key[self.words[at + i]]
        return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(20)


def _portions(batches: Iterator[pa.RecordBatch], stopwords: list[str] | None, segments: bool, most_words: int = 1) -> Iterator[Portion]:
    """The documents (scopes..., text) of a task; between two portions words may be forgotten."""
    vocabulary, words, scope_of, scopes, held = T.Vocabulary(stopwords), [], [], {}, 0
    for b in batches:
        for *scope, text in zip(*(c.to_pylist() for c in b.columns[:-1]), b.columns[-1], strict=True):
            words.append(vocabulary.numbers(text.as_py() or "", segments))
            # a document ends a segment as well
            words[-1] = np.append(words[-1], np.int32(0))
            scope_of.append(scopes.setdefault(tuple(scope), len(scopes)))
            held += len(words[-1])
            # a document is a word at least, with the end of its last segment: fewer than 2**20 of them
            if held >= PORTION or len(vocabulary) >= KNOWN:
                yield Portion(vocabulary, words, scope_of, list(scopes), most_words)
                words, scope_of, scopes, held = [], [], {}, 0
                if len(vocabulary) >= KNOWN:
                    vocabulary.forget()
    if words:
        yield Portion(vocabulary, words, scope_of, list(scopes), most_words)


def _tallied(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The different rows of columns of numbers, in order, and how often each comes."""
    packed, widths = [], []
    for c in columns:
        bits = max(1, int(c.max()).bit_length() if len(c) else 1)
        if not widths or sum(widths[-1]) + bits > 63:
            packed.append(c.astype(np.int64))
            widths.append([bits])
        else:
            packed[-1] = packed[-1] << bits | c
            widths[-1].append(bits)
    if len(packed) == 1:
        packed[0].sort()
    else:
        order = np.lexsort(packed[::-1])
        packed = [p[order] for p in packed]
    first = _starts(packed)
    out = []
    for p, each in zip(packed, widths, strict=True):
        code, of = p[first], []
        for bits in reversed(each):
            of.append(code & ((1 << bits) - 1))
            code = code >> bits
        out += of[::-1]
    return out, np.diff(first, append=len(packed[0]))


def _starts(columns: list[np.ndarray]) -> np.ndarray:
    """Where rows in order are other than the one before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _of_documents(columns: list[np.ndarray], doc: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The different rows of columns of numbers, in order, and in how many documents each is."""
    rows, _ = _tallied([*columns, doc])
    first = _starts(rows[:-1])
    return [c[first] for c in rows[:-1]], np.diff(first, append=len(rows[-1]))


def _hashes(docs: DataFrame, most_words: int, stopwords: list[str] | None, words: bool = False) -> DataFrame:
    """(scope, h, pages) of the documents (scope, text) of a task: in how many of them the keys of a hash are, in portions of HELD; with ``words``
    those of all the words that a run may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            h, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(h)
            h, n = h[order], n[order]
            first = _starts([h])
            return h[first], np.add.reduceat(n, first) if len(first) else n

        def batch(scope: str | None, h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([scope], pa.string()).take(pa.array(np.zeros(len(h), np.int32))), pa.array(h.astype(np.int64)), pa.array(n)], ["scope", "h", "pages"])

        size = 0
        for p in _portions(batches, stopwords, True, most_words):
            for n, at in [(1, p.plain())] if words else p.runs(most_words):
                # by document, each hash once: documents of a portion and a hash are one number
                hashed = p.hashes(n, at) | p.doc[at].astype(np.uint64) << np.uint64(44)
                of = p.scope_of[p.doc[at]]
                if len(p.scopes) > 1:
                    order = np.argsort(of, kind="stable")
                    hashed, of = hashed[order], of[order]
                bounds = _starts([of])
                for i, both in zip(of[bounds], np.split(hashed, bounds[1:])):
                    both.sort()
                    h = both[_starts([both])] & np.uint64(_HASH)
                    h.sort()
                    first = _starts([h])
                    held.setdefault(p.scopes[i][0], []).append((h[first], np.diff(first, append=len(h)).astype(np.int64)))
                    size += len(first)
            if size >= HELD:
                held = {scope: [merged(parts)] for scope, parts in held.items()}
                size = sum(len(h) for [(h, _)] in held.values())
                if size >= HELD // 2:
                    for scope, [(h, n)] in held.items():
                        yield batch(scope, h, n)
                    held, size = {}, 0
        for scope, parts in held.items():
            yield batch(scope, *merged(parts))

    return docs.select("scope", "text").mapInArrow(run, "scope string, h long, pages long")


def _surfaces(docs: DataFrame, most_words: int, stopwords: list[str] | None, table: Callable[[], np.ndarray], words_only: bool = False) -> DataFrame:
    """Counts of (scope, n, key, surface) over the documents (scope, text) of a task, of the keys whose hashes are in the table, or whose words'
    hashes: count, and pages, those of a key with one of its surfaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table()
        last = np.uint64(len(bits) * 8 - 1)

        def known(h: np.ndarray) -> np.ndarray:
            cell = h & last
            return bits[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8) & 1 > 0

        for p in _portions(batches, stopwords, True, most_words):
            surfaces, keys, scopes = pa.array(p.vocabulary.surfaces), pa.array(p.vocabulary.keys), pa.array([s[0] for s in p.scopes], pa.string())
            if words_only:
                fit, plain = np.zeros(len(p.words), bool), p.plain()
                fit[plain] = known(p.hashes(1, plain))
            for n, at in p.runs(most_words):
                at = at[np.logical_and.reduce([fit[at + i] for i in range(n)]) if words_only else known(p.hashes(n, at))]
                if not len(at):
                    continue
                words, doc = [p.words[at + i] for i in range(n)], p.doc[at]
                [scope, *said], count = _tallied([p.scope_of[doc], *words])
                named = [scope, *(p.key[w] for w in said)]
                order = np.lexsort(named[::-1])
                named, said, count = [c[order] for c in named], [c[order] for c in said], count[order]
                # keys in the same order on both sides
                _, of_key = _of_documents([p.scope_of[doc], *(p.key[w] for w in words)], doc)
                pages = np.zeros(len(count), np.int64)
                pages[_starts(named)] = of_key
                joined = lambda texts, columns: texts.take(pa.array(columns[0])) if n == 1 else pc.binary_join_element_wise(*[texts.take(pa.array(c)) for c in columns], " ")  # noqa: E731, B023
                for i in range(0, len(count), 1 << 17):
                    part = slice(i, i + (1 << 17))
                    yield pa.RecordBatch.from_arrays(
                        [scopes.take(pa.array(named[0][part])), pa.array(np.full(len(count[part]), n, np.int32)), joined(keys, [c[part] for c in named[1:]]), joined(surfaces, [c[part] for c in said]), pa.array(count[part].astype(np.int64)), pa.array(pages[part])],
                        ["scope", "n", "key", "surface", "count", "pages"],
                    )

    return docs.select("scope", "text").mapInArrow(run, "scope string, n int, key string, surface string, count long, pages long")


def count_terms(docs: DataFrame, by: list[str], stopwords: list[str] | None = None) -> DataFrame:
    """(*by, term, docs): in how many of the documents ``docs(*by, text)`` each of the terms of ``T.terms`` is, by the columns of ``by``."""
    types = {f.name: f.dataType for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def noted() -> Iterator[pa.RecordBatch]:
            for b in batches:
                kinds[:] = [c.type for c in b.columns[:-1]]
                # documents without a column to count them by have one all the same
                yield b if kinds else pa.RecordBatch.from_arrays([pa.nulls(b.num_rows), b.column(0)], ["all", "text"])

        for p in _portions(noted(), stopwords, False):
            at = np.flatnonzero(p.kind[p.words[: len(p.doc)]] & 3 == 2)
            doc = p.doc[at]
            [scope, key], n = _of_documents([p.scope_of[doc], p.key[p.words[at]]], doc)
            groups = [pa.array([s[i] for s in p.scopes], kind).take(pa.array(scope)) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*groups, pa.array(p.vocabulary.keys).take(pa.array(key)), pa.array(n.astype(np.int64))], [*by, "term", "docs"])

    named = ", ".join([*(f"`{c}` {types[c].simpleString()}" for c in by), "term string, docs long"])
    return spread(docs.select(*by, "text")).mapInArrow(run, named).groupBy(*by, "term").agg(F.sum("docs").alias("docs"))


def _filter(frequent: DataFrame, n: int) -> np.ndarray:
    """Bits of the hashes in ``frequent(h)``, as bytes; of bounded size, whatever their number n."""
    bits = max(1 << 16, min(MOST_BITS, 1 << (16 * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, np.zeros(1 << 13, np.uint8)
        for b in batches:
            cells = b.column(0).to_numpy()
            for part in np.split(cells, np.flatnonzero(np.diff(cells >> 16)) + 1):
                if not len(part):
                    continue
                if part[0] >> 16 != at:
                    if at is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([block.tobytes()])], ["block", "bits"])
                    at, block = int(part[0] >> 16), np.zeros(1 << 13, np.uint8)
                low = part & 0xFFFF
                np.bitwise_or.at(block, low >> 3, (1 << (low & 7)).astype(np.uint8))
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([block.tobytes()])], ["block", "bits"])

    cell = F.col("h").bitwiseAND(F.lit(bits - 1))
    dealt = frequent.select(cell.alias("cell")).withColumn("block", F.shiftright("cell", 16)).repartition("block").sortWithinPartitions("cell").select("cell")
    whole = np.zeros(bits >> 3, np.uint8)
    for r in dealt.mapInArrow(run, "block long, bits binary").toLocalIterator():
        whole[r.block << 13 : (r.block + 1) << 13] |= np.frombuffer(bytes(r.bits), np.uint8)
    return whole


def mine_phrases(docs: DataFrame, most_words: int = 3, least_pages: int = 2, stopwords: list[str] | None = None, scope: Column | None = None, least_of: DataFrame | None = None) -> DataFrame:
    """(key, n, pages, total, display) from (text): in how many documents, how often, and the most frequent
    surface (of equals the shorter, then the lesser); stems as key, stop words as they are. With ``scope``, a text, each scope
    by itself, named in a column of that name; with ``least_of(scope, least)`` only scopes that it has, and phrases on as many pages at least.

    Texts are arrays of the numbers of their words. First only hashes of keys and on how many pages are counted, in each task before they are
    shuffled; those of ``least_pages`` make a filter of bounded size. Then the phrases that pass it, few of all, are counted with their surfaces and by
    their keys, exactly. With ``least_of`` the filter is of single words: no phrase is on more pages than each of its words, and few words are on so many.
    """
    spark, of = docs.sparkSession, [] if scope is None else ["scope"]
    docs = spread(docs.select((F.lit(None) if scope is None else scope).cast("string").alias("scope"), "text"))

    def kept(counted: DataFrame) -> DataFrame:
        enough = counted.where(F.col("pages") >= least_pages)
        return enough if least_of is None else enough.join(least_of.select("scope", "least"), "scope").where(F.col("pages") >= F.col("least"))

    every = _hashes(docs, most_words, stopwords, least_of is not None).groupBy(*of, "h").agg(F.sum("pages").alias("pages"))
    frequent = written(kept(every).select("h"), "phrase-hashes")
    bits = spark.sparkContext.broadcast(_filter(frequent, frequent.count()))
    by_surface = _surfaces(docs, most_words, stopwords, lambda: bits.value, least_of is not None).groupBy(*of, "key", "n", "surface").agg(F.sum("count").alias("count"), F.sum("pages").alias("pages"))
    best = by_surface.groupBy(*of, "key", "n").agg(
        F.sum("pages").alias("pages"), F.sum("count").alias("total"), F.min_by("surface", F.struct(-F.col("count"), F.length("surface"), F.col("surface"))).alias("display")
    )
    discard(frequent)
    return kept(best).select(*of, "key", "n", "pages", "total", "display")


def prune_subsumed(stats: DataFrame, tolerance: float = 0.85) -> DataFrame:
    """Without the keys that a longer phrase, of the same scope if there are scopes, contains on nearly as many pages."""
    of = [c for c in ("scope",) if c in stats.columns]
    # read twice, and what mined it goes over all texts
    stats = written(stats, "phrases")
    parts = F.split("key", " ")

    def runs(m: int) -> Column:
        joined = F.transform(F.sequence(F.lit(1), F.col("n") - (m - 1)), lambda i: F.array_join(F.slice(parts, i, F.lit(m)), " "))
        return F.when(F.col("n") > m, joined).otherwise(F.array().cast("array<string>"))

    inner = F.flatten(F.array(runs(1), runs(2)))
    longer = stats.where(F.size(parts) > 1).select(*of, F.explode(F.array_distinct(inner)).alias("key"), "pages")
    most = longer.groupBy(*of, "key").agg(F.max("pages").alias("longer_pages"))
    return stats.join(most, [*of, "key"], "left").where(F.coalesce("longer_pages", F.lit(0)) < F.col("pages") * F.lit(tolerance)).drop("longer_pages")


def subtopics(headings: DataFrame, keyword_terms: Column | None = None, share: float = 0.25, most: int = 12) -> DataFrame:
    """(scope, topic, pages, place): clusters of headings on a quarter of a scope's pages, two at least,
    without the keyword's own terms; the ``most`` common."""
    total = headings.groupBy("scope").agg(F.count_distinct("doc").alias("all"))
    found = written(heading_clusters(headings, ignore=keyword_terms), "cluster-found")
    kept = cluster_pages(found).join(total, "scope").where(F.col("pages") >= F.greatest(F.lit(2).cast("double"), F.ceil(F.col("all") * share)))
    # topics are made of the few clusters that are kept
    kept = topics_of(found, written(kept.select(*OF, "pages"), "cluster-kept"))
    placed = kept.withColumn("place", F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("pages"), "topic")))
    return placed.where(F.col("place") <= most).select("scope", "topic", "pages", "place")


def duplicate_values(pages: DataFrame, scope: str, value: Column, name: str) -> DataFrame:
    """``pages`` with how many of the scope have the same value; 1 where it is missing."""
    norm = T.for_compare(value)
    counts = pages.select(scope, norm.alias("__v")).where("__v is not null and __v <> ''").groupBy(scope, "__v").agg(F.count(F.lit(1)).alias(name))
    return pages.withColumn("__v", norm).join(counts, [scope, "__v"], "left").withColumn(name, F.coalesce(name, F.lit(1).cast("long"))).drop("__v")


def most_frequent(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), value)))


__all__ = ["mine_phrases", "prune_subsumed", "cluster_headings", "subtopics", "cluster_questions", "duplicate_values", "most_frequent"]
