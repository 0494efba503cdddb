"""Words `[^\\x20\\x09-\\x0D]+` of many texts at once, hashed in numpy with bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes looked at together; the arrays of one step take about 60 times as much.
CHUNK = 1 << 19
#: Longer words are hashed one by one.
LONG = 64
_U = np.uint64
_SEED = _U(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, grown as needed. base must be odd."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK + 1, 0 if have is None else 2 * len(have[0]))
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, dtype=np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        have = _POWERS[base] = (out[0], out[1])
    return have


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.concatenate(([False], ~_SPACE[buf], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[0::2], edge[1::2]


def _hashed(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the words of one chunk, and two hashes of 64 bits, drawn apart, of each.

    Eight bytes at a time enter a state that is mixed in between, so no words of a special form
    collide, as they do in a polynomial modulo 2**64; words of up to eight bytes never do.
    """
    starts, ends = spans(buf)
    if not len(starts):
        return starts, np.zeros((2, 0), np.uint64)
    size = ends - starts
    eight = np.ndarray((len(buf),), "<u8", np.concatenate((buf, np.zeros(8, np.uint8))), strides=(1,))
    out = np.stack((size.astype(np.uint64), ~size.astype(np.uint64))) * _SEED
    some = np.flatnonzero(size <= LONG)
    for at in range(0, LONG, 8):
        if not len(some):
            break
        left = size[some] - at
        block = eight[starts[some] + at] & _MASKS[np.minimum(left, 8)]
        out[0, some] = mix64(out[0, some] + block)
        out[1, some] = mix64((out[1, some] ^ block) * _SEED)
        some = some[left > 8]
    for i in np.flatnonzero(size > LONG).tolist():
        out[:, i] = np.frombuffer(xxhash.xxh3_128_digest(buf[starts[i] : ends[i]].tobytes()), "<u8")
    return starts, out


def _cut(data: bytes) -> Iterator[bytes]:
    """Pieces of a long text that end before white space, so that no word is cut."""
    at = 0
    while len(data) - at > CHUNK:
        to = at + CHUNK
        buf = np.frombuffer(data, np.uint8, CHUNK, at)
        gaps = np.flatnonzero(_SPACE[buf])
        if len(gaps):
            to = at + int(gaps[-1])
        else:
            while to < len(data) and not _SPACE[data[to]]:
                to += 1
        if to == at:
            to = at + 1
        yield data[at:to]
        at = to
    yield data[at:]


def hashed_words(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last+1, hashes, bounds) for runs of texts: the words of text first+i have the
    columns bounds[i] to bounds[i+1] of hashes, which has two rows. Equal words have equal hashes
    everywhere."""
    i = 0
    while i < len(texts):
        if len(texts[i]) > CHUNK:
            h = np.concatenate([_hashed(np.frombuffer(x, np.uint8))[1] for x in _cut(texts[i])], axis=1)
            yield i, i + 1, h, np.array([0, h.shape[1]])
            i += 1
            continue
        j, total = i, 0
        while j < len(texts) and total + len(texts[j]) + 1 <= CHUNK + 1:
            total += len(texts[j]) + 1
            j += 1
        data = b"\n".join(texts[i:j])
        starts, h = _hashed(np.frombuffer(data, np.uint8))
        begins = np.cumsum([0] + [len(x) + 1 for x in texts[i:j]])
        yield i, j, h, np.searchsorted(starts, begins)
        i = j
