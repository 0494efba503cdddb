"""Validators and carving on built files, whole, cut short and inside others."""

import io
import struct
import wave
import zipfile
import zlib

import pytest

from lumenrank.llm import media


def wav(data=b"\x80" * 10):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 1, 8000, 0, "NONE", ""))
        w.writeframes(data)
    return out.getvalue()


def png():
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def bmp():
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4


def archive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "x" * 40)
    return out.getvalue()


def gz():
    c = zlib.compressobj(9, zlib.DEFLATED, 31)
    return c.compress(b"hello" * 9) + c.flush()


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00;"
JPEG = b"\xff\xd8\xff\xc0" + struct.pack(">H", 11) + b"\x08\0\1\0\1\1\1\x11\0" + b"\xff\xda" + struct.pack(">H", 8) + b"\1\1\0\0\x3f\0" + b"\x12\xff\x00\x34\xff\xd9"
PDF = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\nstartxref\n0\n%%EOF"
MP4 = struct.pack(">I4s4sI", 16, b"ftyp", b"isom", 0) + struct.pack(">I4s", 8, b"moov")
OGG = b"OggS\0\6" + b"\0" * 20 + b"\1\5hello"
CASES = [("audio/wav", wav()), ("image/png", png()), ("image/bmp", bmp()), ("application/zip", archive()), ("application/gzip", gz()), ("image/gif", GIF), ("image/jpeg", JPEG), ("application/pdf", PDF), ("video/mp4", MP4), ("audio/ogg", OGG)]


@pytest.fixture(scope="module")
def search():
    return media.automaton()


@pytest.mark.parametrize("kind,data", CASES)
def test_confirms_and_corrects(kind, data, search):
    got = media.sniff(data, "text/plain", search)
    assert (got["type"], got["confirmed"], got["corrected"]) == (kind, True, True)
    assert not media.sniff(data, kind, search)["corrected"]


@pytest.mark.parametrize("kind,data", CASES)
def test_a_cut_file_is_not_confirmed(kind, data, search):
    cut = media.sniff(data[: len(data) - 6], "x/y", search)
    assert not cut["confirmed"] and cut["type"] == "x/y"


@pytest.mark.parametrize("kind,data", CASES)
def test_carves(kind, data, search):
    got = media.sniff(b"some text BM PK " + data + b" and more", "text/plain", search)
    assert [(e["type"], e["start"], e["length"]) for e in got["embedded"]] == [(kind, 16, len(data))]
    inside = media.sniff(wav(b"\x80" * 7 + data + b"\x80" * 5), "audio/wav", search)
    assert inside["type"] == "audio/wav" and [(e["type"], e["start"], e["length"]) for e in inside["embedded"]] == [(kind, 51, len(data))]


def test_dataframe_keeps_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, bytearray(png()), "a/b"), (2, None, None), (3, bytearray(b""), None)], "k int, media binary, declared string")
    rows = {r.k: r.sniffed for r in media.sniff_media(df).collect()}
    assert rows[1].type == "image/png" and rows[2] is None and rows[3].type is None and not rows[3].confirmed


#: Units that repeated over a megabyte make each hit look at the rest, and what ends the object.
CHAINS = [
    *((m, b"") for m, _, _ in media.MAGIC), (b"%PDF-", b"%%EOF"), (b"%PDF-", b"startxref"), (b"startxref%PDF-", b"%%EOF"), (b"PK\3\4", b"PK\5\6"), (b"PK\3\4", b"PK\5\6" + b"\0" * 18),
    (b"\0\0\0\x08ftyp", b""), (b"OggS" + b"\0" * 23, b""), (b"OggS" + b"\0" * 23, b"OggS" + b"\0" * 22 + b"\5"), (b"GIF89aGGGG\0!!!", b""), (b"GIF89a\1\0\1\0\0\0\0!\xf9\1", b""),
    (b"\xff\xd8\xff\xe0\0\2", b""), (b"\xff\xd8\xff\xda\0\2", b""), (b"\xff\xd8\xff\xda\0\2\xff\0", b""), (b"\xff\xd8\xff\xc0\0\4", b"\xff\xda"), (b"fLaC\0\0\0\x22" + b"\0" * 34, b""), (b"RIFF\x20\0\0\0WAVEabcd", b""),
    (b"\x89PNG\r\n\x1a\n\0\0\0\x0dIHDR" + b"\0" * 17, b""), (b"\x1f\x8b\x08\0", b""), (b"\x1f\x8b\x08\x08", b"\0" + b"\1\xff\xff\0\0" + b"x" * 65535), (b"BM" + b"\0" * 8, b""),
]


def seconds(data, search):
    import time

    took = []
    for _ in range(3):
        began = time.process_time()
        media.sniff(data, None, search)
        took.append(time.process_time() - began)
    return min(took)


@pytest.mark.parametrize("unit,end", CHAINS)
def test_magic_takes_time_in_proportion(unit, end, search):
    """As growth, since machines differ; what is over in a hundredth of a second may vary."""
    once, twice = (seconds(unit * (n // len(unit)) + end, search) for n in (1 << 19, 1 << 20))
    assert twice < 3 * once + 0.02


def test_png_heads_that_share_an_end(search):
    """Each head's IDAT reaches the one IEND, so all lengths hold; the check sum is right for the last, whose IDAT is empty."""

    def made(n):
        head, tail = png()[:33], png()[-12:]
        size = len(head) + 8
        body = bytearray((head + b"\0\0\0\0IDAT") * (n // size))
        for at in range(0, len(body), size):
            body[at + 33 : at + 37] = (len(body) - at - size).to_bytes(4, "big")
        return bytes(body) + zlib.crc32(b"IDAT").to_bytes(4, "big") + tail

    once, twice = (seconds(made(n), search) for n in (1 << 19, 1 << 20))
    assert twice < 3 * once + 0.02
    assert media.sniff(made(1 << 14), None, search)["embedded"] == []


def test_check_sums_of_parts():
    import random

    draw = random.Random(4)
    data = draw.randbytes(50_000)
    marks = media.Marks(data)
    for _ in range(300):
        lo, hi = sorted(draw.choices(range(len(data) + 1), k=2))
        assert marks.crc(lo, hi) == zlib.crc32(data[lo:hi])


def test_marks_change_no_result(search):
    """Each hit judged with what earlier hits left behind, and anew."""
    import random

    draw = random.Random(3)
    pieces = [d for _, d in CASES] + [d[: len(d) // 2] for _, d in CASES] + [u for u, _ in CHAINS] + [e for _, e in CHAINS] + [b"\0", b"some text", b"\xff"]
    for _ in range(400):
        data = b"".join(draw.choices(pieces, k=draw.randrange(1, 25)))
        kept = media.Marks(data)
        for end, (size, place, kind) in search.iter(data.decode("latin-1")):
            at = end + 1 - size - place
            if at >= 0:
                assert media.CHECKS[kind](data, at, kept) == media.CHECKS[kind](data, at, media.Marks(data)), (kind, at)
