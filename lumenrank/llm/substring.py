"""Removing passages of words that repeat across documents, behind a count-min prefilter.

A window is ``size`` consecutive words of one document. Each window has an anchor: of the runs
of ``gram`` words in it, the one of least hash. Equal windows have equal anchors, so the number
of documents with its anchor is never below the number with the window, and neighbouring
windows mostly share theirs, which leaves one anchor in about ten words to count.

First pass: each partition counts its documents' anchors in a count-min sketch, sent as sparse
blocks; the merged blocks, cut to two bits a cell (counted twice or more, counted more than
``few`` times), are small enough to hand to all, at most 4 * ``most_cells`` / 8 bytes. Second
pass: windows whose anchor was counted twice are grouped exactly by 96 bits of their word
sequence; the estimate is never too low, so none is lost, and a fuller sketch lets through more
but changes no result.

A document sends a window once, with its first place, so a key has at most as many rows as its
anchor was counted. Keys counted ``few`` times or less meet in one shuffle, whose groups are
bounded by that. Those counted more often take partial minima first, written to the shared
folder; their rows meet them in a join of two tables, which can be broadcast or split by Spark
where one key holds much of the rows.

Texts met before in the same task are not sent again: with ``size`` words or more they are
removed as a whole if their id is the greater.

Rows: null text has no words; rows repeating an id are one document to each other (not removed
for one another) and come out once each; a null id is smaller than all others; a table without
repeats comes out as it is.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize
from ._words import hashed_words, mix64, powers, texts_of

SIZE, GRAM = 50, 20
ROWS, FEW = 2, 4096
SEEN = 1 << 18  # texts a task remembers
_CELLS = 1 << 16  # of a block
_U = np.uint64
_BASES = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)
_NONE = -(1 << 63)  # stands for a null id, below all others


def _rolled(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hash of every n consecutive values."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    up, down = powers(base, len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix64((total[n:] - total[:-n]) * down[: len(h) - n + 1])


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n consecutive values."""
    done = 1
    while done < n:
        step = min(done, n - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def anchors(h: np.ndarray, size: int, gram: int) -> np.ndarray:
    """One for each window of a document with word hashes h."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    return _least(_rolled(h, gram, _BASES[0]), size - gram + 1)


def _cells(a: np.ndarray, bits: int) -> list[np.ndarray]:
    return [mix64(a + _U((r + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> _U(64 - bits) for r in range(ROWS)]


def _documents(b: pa.RecordBatch) -> Iterator[tuple[int, bytes, np.ndarray]]:
    ids, texts = b.column(0).to_pylist(), texts_of(b.column(1))
    for lo, hi, h, bounds in hashed_words(texts):
        for i in range(lo, hi):
            yield _NONE if ids[i] is None else ids[i], texts[i], h[:, bounds[i - lo] : bounds[i - lo + 1]]


def _windows(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of each window, from hashes of the words that were drawn apart."""
    return _rolled(h[0], size, _BASES[1]), _rolled(h[1], size, _BASES[2]) >> _U(32)


def sketch_bits(docs: DataFrame, size: int = SIZE, gram: int = GRAM, most_cells: int = 1 << 29, few: int = FEW) -> tuple[int, dict[tuple[int, int], tuple[bytes, bytes]]]:
    """Merged sketch: log2 of the cells of a row, and by (row, block) two bits a cell: counted
    twice or more, and more than ``few`` times (empty where no cell was)."""
    if not 2 <= few < 65535:
        raise ValueError("few must fit a cell")
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    bits = min(max(17, int(total // 24).bit_length()), most_cells.bit_length() - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if not found:
                return
            out: tuple[list, ...] = ([], [], [], [])
            for r, cells in enumerate(_cells(np.concatenate(found), bits)):
                cell, n = np.unique(cells, return_counts=True)
                block = (cell >> _U(16)).astype(np.int64)
                cut = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
                low, many = (cell & _U(0xFFFF)).astype("<u2"), np.minimum(n, 65535).astype("<u2")
                for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    for to, x in zip(out, (r, int(block[lo]), low[lo:hi].tobytes(), many[lo:hi].tobytes()), strict=True):
                        to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], ["r", "block", "cells", "counts"])

        found: list[np.ndarray] = []
        held = 0
        for b in batches:
            for _, _, h in _documents(b):
                if h.shape[1] < size:
                    continue
                one = np.unique(anchors(h[0], size, gram))
                found.append(one)
                held += len(one)
                if held > 1 << 21:
                    yield from flush(found)
                    found, held = [], 0
        yield from flush(found)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cells = None, np.zeros(_CELLS, np.uint32)

        def done() -> pa.RecordBatch:
            hot = cells > few
            packed = [np.packbits(cells >= 2).tobytes()], [np.packbits(hot).tobytes() if hot.any() else b""]
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int64()), *(pa.array(x, pa.binary()) for x in packed)], ["r", "block", "bits", "hot"])

        for b in batches:
            for r, block, low, many in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (r, block) != at:
                    if at is not None:
                        yield done()
                    at, cells = (r, block), np.zeros(_CELLS, np.uint32)
                i = np.frombuffer(low, "<u2")
                cells[i] = np.minimum(cells[i] + np.frombuffer(many, "<u2"), 65535)
        if at is not None:
            yield done()

    parts = docs.select("id", "text").mapInArrow(count, "r int, block long, cells binary, counts binary")
    merged = parts.repartition("r", "block").sortWithinPartitions("r", "block").mapInArrow(merge, "r int, block long, bits binary, hot binary")
    full = materialize(merged, "sketch")
    return bits, {(x.r, x.block): (bytes(x.bits), bytes(x.hot)) for x in full.toLocalIterator()}


def repeated_windows(docs: DataFrame, bits: int, blocks, hot: bool, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """(h1, h2, id, tag, start) of the windows whose anchor the sketch (a broadcast of what
    ``sketch_bits`` gives) counts twice, and more than ``few`` times or not as ``hot`` asks; with
    those that are not hot come, of start -1, texts that equal one of a smaller id in the same
    task (h1 then spreads such rows). ``tag`` tells apart the texts of rows repeating an id."""

    def table(which: int) -> list[np.ndarray]:
        out = [np.zeros((max(1, 1 << max(0, bits - 16)), _CELLS // 8), np.uint8) for _ in range(ROWS)]
        for (r, block), packed in blocks.value.items():
            if packed[which]:
                out[r][block] = np.frombuffer(packed[which], np.uint8)
        return [x.reshape(-1) for x in out]

    def in_all(cells: list[np.ndarray], rows: list[np.ndarray]) -> np.ndarray:
        hit = np.ones(len(cells[0]), bool)
        for c, row in zip(cells, rows, strict=True):
            hit &= (row[c >> _U(3)] >> (_U(7) - (c & _U(7))).astype(np.uint8) & 1).astype(bool)
        return hit

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice, often = table(0), table(1)
        seen: dict[bytes, int] = {}
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        held = 0

        def add(h1: np.ndarray, h2: np.ndarray, i: int, text: bytes, at: np.ndarray) -> int:
            tag = zlib.crc32(text)
            for to, x in zip(out, (h1.view(np.int64), h2.astype(np.uint32).view(np.int32), np.full(len(at), i), np.full(len(at), tag), at.astype(np.int32)), strict=True):
                to.append(x)
            return len(at)

        def flush() -> pa.RecordBatch:
            kinds = (np.int64, np.int32, np.int64, np.int64, np.int32)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(t)) for x, t in zip(out, kinds, strict=True)], ["h1", "h2", "id", "tag", "start"])

        for b in batches:
            for i, text, h in _documents(b):
                if h.shape[1] < size:
                    continue
                key = hashlib.md5(text).digest()
                if i > seen.get(key, i):
                    if not hot:
                        held += add(mix64(np.array([i], np.int64).view(np.uint64)), np.zeros(1, np.uint64), i, text, np.array([-1]))
                    continue
                if len(seen) < SEEN or key in seen:
                    seen[key] = i
                cells = _cells(anchors(h[0], size, gram), bits)
                at = np.flatnonzero(in_all(cells, twice))
                if len(at):
                    at = at[in_all([c[at] for c in cells], often) == hot]
                if not len(at):
                    continue
                w1, w2 = (w[at] for w in _windows(h, size))
                _, once = np.unique(w1 ^ mix64(w2), return_index=True)
                once.sort()
                held += add(w1[once], w2[once], i, text, at[once])
                if held > 100_000:
                    yield flush()
                    out, held = [[], [], [], [], []], 0
        if held:
            yield flush()

    return docs.select("id", "text").mapInArrow(find, "h1 long, h2 int, id long, tag long, start int")


def removals(docs: DataFrame, size: int = SIZE, gram: int = GRAM, most_cells: int = 1 << 29, few: int = FEW) -> DataFrame:
    """(id, tag, whole, starts): the first starts of the windows to remove; whole > 0: all words go."""
    bits, blocks = sketch_bits(docs, size, gram, most_cells, few)
    shared = docs.sparkSession.sparkContext.broadcast(blocks)
    rows = repeated_windows(docs, bits, shared, False, size, gram)
    lowest = F.min("id").over(Window.partitionBy("h1", "h2"))  # of a group of ``few`` rows at most
    cut = rows.withColumn("lo", lowest).where("start < 0 or id > lo").select("id", "tag", "start")
    if any(hot for _, hot in blocks.values()):
        often = materialize(repeated_windows(docs, bits, shared, True, size, gram), "hot-windows")
        first = often.groupBy("h1", "h2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h1", "h2", "lo")
        cut = cut.unionByName(often.join(materialize(first, "hot-first"), ["h1", "h2"]).where("id > lo").select("id", "tag", "start"))
    # a document's own windows: as many as it has words, and no more
    return cut.groupBy("id", "tag").agg(F.count_if(F.col("start") < 0).alias("whole"), F.collect_set(F.when(F.col("start") >= 0, F.col("start"))).alias("starts"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM, most_cells: int = 1 << 29, few: int = FEW) -> DataFrame:
    """(id, n_words, n_removed, kept): kept is what is left of each text, words joined by a blank."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    out = removals(plain, size, gram, most_cells, few).withColumnRenamed("id", "k")
    tag = F.crc32(F.col("text").cast("binary"))
    joined = plain.withColumn("k", F.coalesce("id", F.lit(_NONE))).withColumn("tag", tag).join(out, ["k", "tag"], "left").select("id", "text", "whole", "starts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made: tuple[list, list, list] = ([], [], [])
            whole = b.column(2).to_pylist()
            for k, (text, starts) in enumerate(zip(texts_of(b.column(1)), b.column(3), strict=True)):
                words = text.split()
                n = len(words)
                if whole[k] and n >= size:
                    left = []
                elif starts.is_valid and len(starts):
                    edge = np.zeros(n + 1, np.int32)
                    w1, w2 = _windows(next(hashed_words([text]))[2], size)
                    each = w1 ^ mix64(w2)
                    s = np.flatnonzero(np.isin(each, each[starts.values.to_numpy()]))  # wherever such a window is
                    edge[s] += 1
                    edge[s + size] -= 1
                    left = [words[i] for i in np.flatnonzero(np.cumsum(edge[:n]) == 0).tolist()]
                else:
                    left = words
                for to, x in zip(made, (n, n - len(left), b" ".join(left)), strict=True):
                    to.append(x)
            kept = pa.array(made[2], pa.large_binary()).cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made[0], pa.int64()), pa.array(made[1], pa.int64()), kept], ["id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(cut, "id long, n_words long, n_removed long, kept string")
