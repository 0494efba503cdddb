"""Media columns by signature sniffing.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over the stored
bytes. A hit is only a candidate: the format's validator walks its structure and lengths
(chunks, blocks, check sums, end marks) and gives the extent, or turns it down. The format
confirmed at offset 0 corrects the declared type; those confirmed further in are carved.

Many hits of one object share what the validators look at, so an object's ``Marks`` keep it: where
end marks are, found once and searched by halving, and which places of a chain of chunks, boxes,
blocks or pages led nowhere or to which end, so that no chain is walked twice. Check sums of overlapping PNG chunks come
from those of the object's beginnings, and deflate streams are unpacked once for each place that one may start at. Repeated
magic bytes thus cost time in proportion to the object.

Rows: null media gives a null type and no spans; bytes of no known format keep the declared
type with ``confirmed`` false; equal bytes and declarations give equal results, so repeated rows are alike; an object is one
value and judged whole, however long; an empty table gives none; a column called like the output is replaced.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the public format specifications: magic bytes, their place in the file, type.
MAGIC = [
    (b"RIFF", 0, "riff"),
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"BM", 0, "image/bmp"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
    (b"OggS", 0, "audio/ogg"),
    (b"fLaC", 0, "audio/flac"),
    (b"ftyp", 4, "video/mp4"),
]
RIFF_TYPES = {b"WAVE": "audio/wav", b"AVI ": "video/avi", b"WEBP": "image/webp"}

SPAN = T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])
SNIFFED = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("confirmed", T.BooleanType()),
        T.StructField("corrected", T.BooleanType()),
        T.StructField("candidates", T.LongType()),
        T.StructField("payload_start", T.LongType()),
        T.StructField("payload_length", T.LongType()),
        T.StructField("embedded", T.ArrayType(SPAN)),
    ]
)
Found = tuple[str, int, int, int] | None  # type, length, payload start (from the hit), payload length


#: Bytes from one kept check sum to the next.
SUMS = 1 << 12
_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product modulo the crc32 polynomial; bit 31 is the coefficient of 1, bit 0 that of x**31."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ (_POLY if b & 1 else 0)
    return out


def _x_to(n: int) -> int:
    """x**n modulo that polynomial."""
    out, square = 0x80000000, 0x40000000
    while n:
        if n & 1:
            out = _times(out, square)
        square, n = _times(square, square), n >> 1
    return out


class Marks:
    """What hits in one object have in common."""

    def __init__(self, data: bytes):
        self.data = data
        self.places: dict[bytes, list[int]] = {}
        self.dead: dict[str, set] = {}
        self.ends: dict[int, int] = {}
        self.streams: dict[int, int] = {}
        self.chunks: dict[int, tuple[int, bool]] = {}
        self.sums: list[int] = []

    def next(self, mark: bytes, at: int) -> int:
        """First place of ``mark`` from ``at`` on, or -1; marks do not overlap themselves."""
        found = self.places.get(mark)
        if found is None:
            found, pos = [], self.data.find(mark)
            while pos >= 0:
                found.append(pos)
                pos = self.data.find(mark, pos + len(mark))
            self.places[mark] = found
        k = bisect_left(found, at)
        return found[k] if k < len(found) else -1

    def lost(self, kind: str, walked: list) -> None:
        """The places of a chain that led nowhere."""
        self.dead.setdefault(kind, set()).update(walked)

    def is_lost(self, kind: str, place) -> bool:
        return place in self.dead.get(kind, ())

    def _sum_to(self, at: int) -> int:
        """crc32 of the object up to ``at``, from the last of those kept for every SUMS bytes."""
        if not self.sums:
            self.sums = [0]
            for lo in range(0, len(self.data), SUMS):
                self.sums.append(zlib.crc32(memoryview(self.data)[lo : lo + SUMS], self.sums[-1]))
        k = at // SUMS
        return zlib.crc32(memoryview(self.data)[k * SUMS : at], self.sums[k])

    def crc(self, lo: int, hi: int) -> int:
        """crc32 of a part. That of a long one comes from the sums up to both its ends, as crc(ab) is crc(a) times x**(8 len(b))
        plus crc(b): so parts that overlap cost no more than one another."""
        if hi - lo <= SUMS:
            return zlib.crc32(memoryview(self.data)[lo:hi])
        return self._sum_to(hi) ^ _times(self._sum_to(lo), _x_to(8 * (hi - lo)))

    def sub_blocks(self, at: int) -> int:
        """Place after the chain of length-prefixed blocks at ``at``."""
        d, walked = self.data, []
        while at < len(d) and d[at] and at not in self.ends:
            walked.append(at)
            at += d[at] + 1
        end = self.ends.get(at, at + 1)
        self.ends.update(dict.fromkeys(walked, end))
        return end


def _riff(d: bytes, at: int, marks: Marks) -> Found:
    if len(d) < at + 12:
        return None
    size, form = struct.unpack_from("<I4s", d, at + 4)
    kind, end = RIFF_TYPES.get(form), at + 8 + size
    if kind is None or size < 4 or end > len(d):
        return None
    pos, payload, seen, walked = at + 12, None, 0, []
    while pos < end:
        walked.append((pos, end))
        name, n = struct.unpack_from("<4sI", d, pos) if pos + 8 <= end else (b"\0" * 4, 0)
        if marks.is_lost("riff", (pos, end)) or pos + 8 + n > end or not all(0x20 <= c < 0x7F for c in name) or name == b"fmt " and n < 16:
            marks.lost("riff", walked)
            return None
        if name == b"data" and payload is None:
            payload = (pos + 8 - at, n)
        seen += name == b"fmt "
        pos += 8 + n + (n & 1)
    if kind == "audio/wav" and (payload is None or not seen):
        return None
    return kind, 8 + size, *(payload or (12, size - 4))


def _png(d: bytes, at: int, marks: Marks) -> Found:
    pos, walked, end, data = at + 8, [], None, False
    if d[pos : pos + 8] != b"\0\0\0\x0dIHDR":
        return None
    while pos + 12 <= len(d) and not marks.is_lost("png", pos):
        if pos in marks.chunks:
            end, data = marks.chunks[pos]
            break
        n, name = struct.unpack_from(">I4s", d, pos)
        walked.append((pos, n, name))
        pos += 12 + n
        if name == b"IEND" and pos <= len(d):
            end = pos
            break
    if end is None:
        marks.lost("png", [p for p, _, _ in walked])
        return None
    while walked:  # lengths hold: now the check sums, from the end, so that what stands behind a wrong one is known to be right
        p, n, name = walked.pop()
        if marks.crc(p + 4, p + 8 + n) != struct.unpack_from(">I", d, p + 8 + n)[0]:
            marks.lost("png", [p, *(x for x, _, _ in walked)])
            return None
        data |= name == b"IDAT" and n > 0
        marks.chunks[p] = (end, data)
    return ("image/png", end - at, 8, end - at - 8) if data else None


def _gif(d: bytes, at: int, marks: Marks) -> Found:
    if len(d) < at + 14:
        return None
    w, h, flags = struct.unpack_from("<HHB", d, at + 6)
    pos = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    images, walked = False, []
    while w and h and pos < len(d) and not marks.is_lost("gif", (pos, images)):
        mark = d[pos]
        walked.append((pos, images))
        if mark == 0x3B and images:
            return "image/gif", pos + 1 - at, 13, pos - at - 13
        if mark == 0x21:
            pos = marks.sub_blocks(pos + 2)
        elif mark == 0x2C and pos + 10 <= len(d):
            local = d[pos + 9]
            pos = marks.sub_blocks(pos + 11 + (3 << (local & 7) + 1 if local & 0x80 else 0))
            images = True
        else:
            break
    marks.lost("gif", walked)
    return None


def _jpeg(d: bytes, at: int, marks: Marks) -> Found:
    pos, frame, walked = at + 2, False, []
    while pos + 4 <= len(d) and d[pos] == 0xFF and not marks.is_lost("jpeg", (pos, frame)):
        mark = d[pos + 1]
        walked.append((pos, frame))
        if mark == 0xFF:  # a fill byte
            pos += 1
            continue
        n = struct.unpack_from(">H", d, pos + 2)[0]
        if n < 2 or mark < 0xC0 or 0xD0 <= mark <= 0xD9 or pos + 2 + n > len(d):
            break
        frame |= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        pos += 2 + n
        if mark == 0xDA:  # entropy-coded data runs to a marker other than a restart
            pos = _marker(d, pos, marks)
            if pos < 0:
                break
            if d[pos + 1] == 0xD9:
                return ("image/jpeg", pos + 2 - at, 2, pos - at - 2) if frame else None
    marks.lost("jpeg", walked)
    return None


def _marker(d: bytes, pos: int, marks: Marks) -> int:
    """Place of the next marker that is no restart, or -1."""
    passed = []
    while (pos := d.find(b"\xff", pos)) >= 0 and pos + 1 < len(d) and (d[pos + 1] == 0 or 0xD0 <= d[pos + 1] <= 0xD7):
        if (known := marks.ends.get(-1 - pos)) is not None:
            pos = known
            break
        passed.append(-1 - pos)
        pos += 2
    pos = -1 if pos + 1 >= len(d) else pos
    marks.ends.update(dict.fromkeys(passed, pos))
    return pos


def _bmp(d: bytes, at: int, marks: Marks) -> Found:
    if len(d) < at + 30:
        return None
    size, zero, start, header = struct.unpack_from("<IIII", d, at + 2)
    planes, bits = struct.unpack_from("<HH", d, at + 26)
    if zero or header not in (40, 52, 56, 64, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32):
        return None
    if not 14 + header <= start <= size or at + size > len(d):
        return None
    return "image/bmp", size, start, size - start


def _pdf(d: bytes, at: int, marks: Marks) -> Found:
    end, table = marks.next(b"%%EOF", at), marks.next(b"startxref", at)
    if end < 0 or not 0 <= table <= end - 9:
        return None
    return "application/pdf", end + 5 - at, 0, end + 5 - at


def _zip(d: bytes, at: int, marks: Marks) -> Found:
    end = marks.next(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(d):
        return None
    entries, size, start, note = struct.unpack_from("<HIIH", d, end + 10)
    if at + start + size != end or not entries or d[at + start : at + start + 4] != b"PK\x01\x02" or end + 22 + note > len(d):
        return None
    return "application/zip", end + 22 + note - at, 0, end + 22 + note - at


def _gzip(d: bytes, at: int, marks: Marks) -> Found:
    if len(d) < at + 18 or d[at + 3] & 0xE0:
        return None
    flags, pos = d[at + 3], at + 10
    if flags & 4:
        pos += 2 + d[pos] + 256 * d[pos + 1]
    for text in (8, 16):  # name and comment end in a zero
        if flags & text and pos < len(d):
            pos = marks.next(b"\0", pos) + 1
            if not pos:
                return None
    pos += flags & 2
    if pos not in marks.streams:
        marks.streams[pos] = _inflated(d, pos)
    end = marks.streams[pos]
    return ("application/gzip", end - at, 10, end - at - 18) if end else None


def _inflated(d: bytes, at: int) -> int:
    """Place after the deflate stream at ``at`` and its right check sum and length, or 0."""
    unpack, size, total, pos, step = zlib.decompressobj(-15), 0, 0, at, 64
    try:
        while not unpack.eof and (pos < len(d) or unpack.unconsumed_tail):
            feed = unpack.unconsumed_tail or d[pos : pos + step]
            pos += 0 if unpack.unconsumed_tail else len(feed)
            out = unpack.decompress(feed, 1 << 20)
            size, total, step = size + len(out), zlib.crc32(out, total), min(2 * step, 1 << 16)
    except zlib.error:
        return 0
    end = pos - len(unpack.unused_data) + 8
    if not unpack.eof or end > len(d):
        return 0
    return end if struct.unpack_from("<II", d, end - 8) == (total, size & 0xFFFFFFFF) else 0


def _ogg(d: bytes, at: int, marks: Marks) -> Found:
    pos, walked = at, []
    while d[pos : pos + 4] == b"OggS" and pos + 27 <= len(d) and d[pos + 4] == 0:
        walked.append(pos)
        table = d[pos + 27 : pos + 27 + d[pos + 26]]
        end = pos + 27 + d[pos + 26] + sum(table)
        if marks.is_lost("ogg", pos) or len(table) < d[pos + 26] or end > len(d):
            marks.lost("ogg", walked)
            return None
        last, pos = d[pos + 5] & 4, end
        if last:
            break
    return ("audio/ogg", pos - at, 0, pos - at) if walked else None


def _flac(d: bytes, at: int, marks: Marks) -> Found:
    pos, walked = at + 4, []
    while pos + 4 <= len(d) and not (walked and marks.is_lost("flac", pos)):
        head, n = d[pos], int.from_bytes(d[pos + 1 : pos + 4], "big")
        if not walked and (head & 0x7F or n != 34):
            return None
        walked.append(pos)
        if pos + 4 + n > len(d):
            break
        pos += 4 + n
        if head & 0x80:
            if pos + 2 <= len(d) and d[pos] == 0xFF and d[pos + 1] & 0xFC == 0xF8:
                return "audio/flac", len(d) - at, pos - at, len(d) - pos
            break
    marks.lost("flac", walked)
    return None


def _mp4(d: bytes, at: int, marks: Marks) -> Found:
    pos, names, walked = at, set(), []
    while pos + 8 <= len(d) and not (marks.is_lost("mp4", pos) and b"moov" not in names):
        n, name = struct.unpack_from(">I4s", d, pos)
        if n < 8 or pos + n > len(d) or not name.isalnum() or not walked and name != b"ftyp":
            break
        walked.append(pos)
        names.add(name)
        pos += n
    if b"moov" in names:
        return "video/mp4", pos - at, 0, pos - at
    marks.lost("mp4", walked)
    return None


CHECKS = {
    "riff": _riff, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "application/pdf": _pdf,
    "application/zip": _zip, "application/gzip": _gzip, "audio/ogg": _ogg, "audio/flac": _flac, "video/mp4": _mp4,
}


def automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for magic, place, kind in MAGIC:
        made.add_word(magic.decode("latin-1"), (len(magic), place, kind))
    made.make_automaton()
    return made


def sniff(data: bytes, declared: str | None, search: ahocorasick.Automaton) -> dict:
    """What SNIFFED describes, for one stored object."""
    top, embedded, hits, past, marks = None, [], 0, 0, Marks(data)
    for end, (size, place, kind) in search.iter(data.decode("latin-1")):
        hits += 1
        at = end + 1 - size - place
        if at < 0 or at and at < past:
            continue
        found = CHECKS[kind](data, at, marks)
        if found is None:
            continue
        if at == 0:
            top = top or found
        else:
            embedded.append({"type": found[0], "start": at, "length": found[1]})
            past = at + found[1]
    kind = top[0] if top else declared
    return {
        "type": kind, "confirmed": top is not None, "corrected": top is not None and kind != declared, "candidates": hits,
        "payload_start": top[2] if top else 0, "payload_length": top[3] if top else len(data), "embedded": embedded,
    }


def sniff_media(df: DataFrame, media_col: str = "media", declared_col: str = "declared", out_col: str = "sniffed") -> DataFrame:
    """``df`` with a struct of SNIFFED; the other columns stay in the JVM."""
    kind = pa.struct(
        [("type", pa.string()), ("confirmed", pa.bool_()), ("corrected", pa.bool_()), ("candidates", pa.int64()), ("payload_start", pa.int64()), ("payload_length", pa.int64()),
         ("embedded", pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64())])))]
    )

    @F.arrow_udf(SNIFFED)
    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        search = automaton()
        for media, declared in parts:
            yield pa.array([None if m.as_py() is None else sniff(m.as_py(), t, search) for m, t in zip(media, declared.to_pylist(), strict=True)], kind)

    return df.withColumn(out_col, run(F.col(media_col), F.col(declared_col)))


def _u32(n: Column) -> Column:
    """Four little-endian bytes."""
    h = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.unhex(F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2)))


def wav_of(samples: Column, rate: int = 8000) -> Column:
    """A binary column of even length as 8-bit mono PCM in a WAVE file, by Spark expressions."""
    n = F.octet_length(samples)
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    return F.concat(F.lit(b"RIFF"), _u32(n + 36), F.lit(b"WAVE" + fmt + b"data"), _u32(n), samples)
