"""Byte-level BPE as a lazily determinised finite-state transducer, and its streaming decoder.

A sequence of tokens is the BPE encoding of its bytes exactly if each neighbouring pair is: no
merge across their border would have come before the merges inside them. So the merges compile
into a transducer that reads bytes along every token that may be under way. Its control state
is the set of trie nodes under way, determinised when first met: they are the suffixes of one
another, so the deepest stands for the set. Besides it keeps, for each position not yet settled,
the one token that can end there: of the tokens ending at a byte, the one that goes with what
ends where it starts. A token is emitted as soon as all that is under way agrees on it, after a
lookahead bounded by the longest token, or when the input ends.

The decoder keeps an incremental UTF-8 state: it lets through whole code points only and holds
the bytes of an unfinished one until the tokens that end it arrive.

Rows: null text counts as empty and has no tokens; equal texts have equal ids; repeated rows
are encoded each; the result has the columns of the input besides the new ones.
"""

from __future__ import annotations

import hashlib
import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._pieces import PieceEncoder


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and number."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


class Transducer:
    #: Positions kept before settled tokens are emitted; several times the longest token.
    PENDING = 4096

    def __init__(self, ranks: dict[bytes, int], most_steps: int = 400_000):
        self.ranks, self.most_steps = ranks, most_steps
        self.token = {r: t for t, r in ranks.items()}
        self.length = {r: len(t) for t, r in ranks.items()}
        kids: list[dict[int, int] | None] = [{}]
        ends: dict[int, int] = {}
        for t, r in ranks.items():
            at = 0
            for b in t:
                below = kids[at]
                if below is None:
                    below = kids[at] = {}
                to = below.get(b)
                if to is None:
                    to = below[b] = len(kids)
                    kids.append(None)
                at = to
            ends[at] = r
        #: node -> deepest node whose path is a proper suffix of its path; tokens that end here
        self.kids, self.back, self.depth = kids, array("i", bytes(4 * len(kids))), array("i", bytes(4 * len(kids)))
        self.ending: list[tuple[tuple[int, int], ...]] = [()] * len(kids)
        level = [0]
        while level:
            below = []
            for node in level:
                for b, to in (kids[node] or {}).items():
                    up = self.back[node] if node else -1
                    while up >= 0 and (kids[up] is None or b not in kids[up]):
                        up = self.back[up] if up else -1
                    self.back[to] = kids[up][b] if up >= 0 else 0
                    self.depth[to] = self.depth[node] + 1
                    shorter = self.ending[self.back[to]]
                    self.ending[to] = ((ends[to], self.depth[to]), *shorter) if to in ends else shorter
                    below.append(to)
            level = below
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[int, bool] = {}
        self.step: dict[int, tuple[int, tuple[tuple[int, int], ...]]] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge inside a token joined; None for a single byte."""
        if token not in self._halves:
            parts = [bytes([b]) for b in self.token[token]]
            while len(parts) > 2:
                rank, i = min(((self.ranks[m], i) for i in range(len(parts) - 1) if (m := parts[i] + parts[i + 1]) in self.ranks), default=(None, 0))
                if rank is None:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._halves[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether a followed by b is what BPE makes of their bytes."""
        key = a << 20 | b
        found = self._fits.get(key)
        if found is None:
            if len(self._fits) > 250_000:
                self._fits.clear()
            found = self._fits[key] = self._check(a, b)
        return found

    def _check(self, a: int, b: int) -> bool:
        """Undo the merges next to the border, the latest first; what stands at the border then
        must not join earlier than the merge just undone. Of equal merges the left comes first."""
        limit = None  # joins below it come too early
        while True:
            across = self.ranks.get(self.token[a] + self.token[b])
            if across is not None and (limit is None or across < limit):
                return False
            left, right = self.halves(a), self.halves(b)
            if left is None and right is None:
                return True
            if right is None or left is not None and a > b:
                limit, a = a, left[1]
            else:
                limit, b = b + 1, right[0]

    def _grow(self, node: int, byte: int) -> tuple[int, tuple[tuple[int, int], ...]]:
        """Determinise one step: the deepest node under way that the byte leads on from."""
        if len(self.step) > self.most_steps:
            self.step.clear()
        at, key = node, node << 8 | byte
        while at and (self.kids[at] is None or byte not in self.kids[at]):
            at = self.back[at]
        to = self.kids[at].get(byte, 0)
        found = self.step[key] = (to, self.ending[to])
        return found

    def encode(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        out: list[int] = []
        last, at, step, known = [-1], 0, self.step, self._fits
        for i, b in enumerate(data, 1):
            at, ending = step.get(at << 8 | b) or self._grow(at, b)
            n = len(last)
            for t, size in ending:
                before = last[n - size]
                if before < 0:
                    break
                fit = known.get(before << 20 | t)
                if fit or fit is None and self.fits(before, t):
                    break
            last.append(t)
            if n > self.PENDING and i < len(data):
                last = self._emit(last, at, out)
        return out + self._path(last, len(last) - 1)

    def _path(self, last: list[int], to: int) -> list[int]:
        """The tokens up to a position; position 0 is where the last emitted token ended."""
        path = []
        while to:
            path.append(last[to])
            to -= self.length[last[to]]
        return path[::-1]

    def _emit(self, last: list[int], at: int, out: list[int]) -> list[int]:
        """Emit what all starts of tokens under way agree on, and keep the rest."""
        ends = [len(last) - 1]
        while at:
            ends.append(len(last) - 1 - self.depth[at])
            at = self.back[at]
        common = None
        for to in ends:
            seen = {to}
            while to:
                to -= self.length[last[to]]
                seen.add(to)
            common = seen if common is None else common & seen
        cut = max(common)
        if cut:
            out += self._path(last, cut)
            last = last[cut:]
        return last

class Encoder:
    """Whole texts: each match of the pattern goes through the transducer alone."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.machine = Transducer(ranks)
        encode = self.machine.encode
        self.pieces = PieceEncoder(pattern, lambda words: [array("I", encode(w.encode())).tobytes() for w in words], keep_pieces=300_000)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.pieces.encode(text), "<u4")


#: UTF-8: from each state (0: between code points) the bytes that lead on. 1-3: so many plain
#: continuation bytes to come; 4-7: after E0, ED, F0, F4, whose next byte is narrower.
UTF8_STEPS = {
    0: [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)],
    1: [(0x80, 0xBF, 0)],
    2: [(0x80, 0xBF, 1)],
    3: [(0x80, 0xBF, 2)],
    4: [(0xA0, 0xBF, 1)],
    5: [(0x80, 0x9F, 1)],
    6: [(0x90, 0xBF, 2)],
    7: [(0x80, 0x8F, 2)],
}
_TABLE = [[0] * 256 for _ in range(8)]  # a byte that leads nowhere is let through as it is
for _s, _steps in UTF8_STEPS.items():
    for _lo, _hi, _to in _steps:
        _TABLE[_s][_lo : _hi + 1] = [_to] * (_hi + 1 - _lo)


class Decoder:
    """feed() gives the bytes of whole code points; close() what is left over."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.whole = np.array([self._after(0, t) == 0 and self._clean(t) for t in tokens])
        self.start()

    @staticmethod
    def _after(state: int, data: bytes) -> int:
        for b in data:
            state = _TABLE[state][b]
        return state

    @staticmethod
    def _clean(data: bytes) -> bool:
        return not data or data[0] < 0x80 or data[0] >= 0xC0

    def start(self) -> None:
        self.state, self.held = 0, b""

    def feed(self, ids: np.ndarray) -> bytes:
        out, tokens, at = [], self.tokens, 0
        for odd in [*np.flatnonzero(~self.whole[ids]).tolist(), len(ids)]:
            if at < odd:
                run = b"".join(map(tokens.__getitem__, ids[at:odd].tolist()))
                out += self._step(run) if self.state else [run]
            if odd < len(ids):
                out += self._step(tokens[int(ids[odd])])
            at = odd + 1
        return b"".join(out)

    def _step(self, data: bytes) -> list[bytes]:
        """Through the state machine; once between code points, whole tokens need no look."""
        done, state, base = 0, self.state, len(self.held)
        for n, b in enumerate(data, base + 1):
            state = _TABLE[state][b]
            if state == 0:
                done = n
        data = self.held + data
        self.state, self.held = state, data[done:]
        return [data[:done]]

    def close(self) -> bytes:
        left = self.held
        self.start()
        return left


_STEP = 4096


def bpe_encode(df: DataFrame, ranks: bytes, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` without its text, with an array column of token ids in place of any column of that name. ``ranks``: the rank file's bytes. A null
    text is an empty one; an empty table gives none."""
    keep = [c for c in df.columns if c not in (text_col, ids_col)]
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _per_process(("encoder", pattern, contents(shared.value)), lambda: Encoder(read_ranks(shared.value), pattern))
        for b in batches:
            for lo, hi in _slices(b.column(len(keep))):
                part = b.slice(lo, hi - lo)
                found = [encoder.encode(t or "") for t in part.column(len(keep)).to_pylist()]
                offsets = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(x) for x in found], out=offsets[1:])
                values = np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], ids], [*keep, ids_col])

    return df.select(*keep, text_col).mapInArrow(run, schema)


def bpe_decode(df: DataFrame, ranks: bytes, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with a binary column of the bytes that the ids stand for."""
    keep = df.columns
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Decoder:
            known = read_ranks(shared.value)
            tokens = [b""] * (max(known.values()) + 1)
            for t, r in known.items():
                tokens[r] = t
            return Decoder(tokens)

        decoder = _per_process(("decoder", contents(shared.value)), made)
        for b in batches:
            col = b.column(keep.index(ids_col))
            values, offsets, out = col.values.to_numpy(), col.offsets.to_numpy(), []
            for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
                decoder.start()
                got = [decoder.feed(values[i : min(i + _STEP, hi)]) for i in range(lo, hi, _STEP)]
                out.append(b"".join([*got, decoder.close()]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*keep, out_col])

    return df.mapInArrow(run, schema)


_MADE: dict = {}


def contents(data: bytes | str) -> bytes:
    """What tells one vocabulary from another, whatever their lengths."""
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).digest()


def _per_process(key, make):
    """One encoder a worker process, kept from task to task; the key has all that it depends on."""
    if key not in _MADE:
        for old in [k for k in _MADE if k[0] == key[0]]:
            del _MADE[old]
        _MADE[key] = make()
    return _MADE[key]


def _slices(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column of about ``most`` bytes each."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(sizes):
        base = sizes[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, base + most, "right")))
        yield lo, hi
        lo = hi
