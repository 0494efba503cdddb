"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood.

One model is trained on random strings, the other on ordinary identifiers, both from labelled
samples. A run of token characters is a secret if the first explains it better by more than a
margin, as a whole or in a long part of it between separators. Runs of letters of one case may be words in some
language and are left to the patterns, as are numbers of fewer than 20 digits.

Rows: null text counts as empty and has no spans; spans are in code points, end exclusive,
ordered by start, then by kind in the order of KINDS; equal texts have equal spans, so repeated rows are alike; a very long text
is one value and scanned whole; an empty table gives none; a column called like the output is replaced.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._words import texts_of

KINDS = ("assign", "access", "hex", "random")
#: Fixed patterns, of bytes: letters match in either case where marked, of ASCII only.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
NAMES = (b"passw", b"secret", b"token", b"api")
LEAST = {"assign": 6, "access": 20, "hex": 24}

RUN = 12  # characters of a run that the models look at, at least; what ACCESS and HEX need is longer
#: Letters and digits, or a small letter before a capital: letters of one case may be a word of any language.
_MIXED = re.compile(rb"[0-9].*[A-Za-z]|[A-Za-z].*[0-9]|[0-9]{20}|[a-z][A-Z]")
PART = 20  # characters between separators that are scored alone: a key may stand behind a path or a name
_ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = np.full(256, -1, np.int64)
_CODE[list(_ALPHABET)] = np.arange(len(_ALPHABET))
_TOKEN = _CODE >= 0


def random_strings(n: int = 4000, seed: int = 11) -> list[str]:
    """Labelled samples: strings drawn at random over the alphabets that keys are written in."""
    draw, letters = random.Random(seed), _ALPHABET.decode()
    sets = ["0123456789ABCDEF", "0123456789abcdef", letters[:26] + "234567", letters[:62], letters[:64], letters[:62] + "-_"]
    return ["".join(draw.choices(draw.choice(sets), k=draw.randint(20, 64))) for _ in range(n)]


#: Words that names in code, paths and addresses are made of.
NAME_WORDS = """
about action admin album amount archive article author balance batch billing board bottom browser build byte calendar cancel
catalog change char chart choice cleanup client cloud color comment compare config contact context copy create cycle database
decode delivery design dialog dict digit dir directory display domain driver edit empty engine enum env errno error excluded
exec execute export factory fetch filter finish format function general gnu graph handler hash header help host http import
initial install int internal io iterator journal json keyword label layout library limit line loader lock log machine map master
maximum memory message middle mode monitor move mutable name native none normal null object open order os owner panel parse path
pending phone pipe player policy post price priority product project provider publish quantity queue quick rank record regex
region remote repeat request response review rotate run schedule score scroll select service setup share signal slice socket
source sql stack start stat station stock str stream structure submit switch sync sys system task tcp terminal test theme time
tool track transform try tuple type unicode upload url uuid value var verify view void volume watch weak weight window write xml
yield zip
""".split()


#: What syllables of words in several European languages open with, have at heart and end in; an opening and an end may be missing.
ONSETS = "b bl br c ch cl cr d dr f fl fr g gl gr h j k kl kn kr l m n p pf pl pr qu r s sch sh sk sl sm sn sp spr st str t th tr v w z zw".split() + [""] * 6
NUCLEI = "a e i o u a e i o e a ai au ea ee ei eu ie io oo ou ue y".split()
CODAS = "n r s t l m d k p ng nt rt st ch ck ll ss nd ns rs ft ht tz x b g c f".split() + [""] * 4
#: Capitals that stand within names.
SHORT = "HTML API URL SQL XML JSON PDF CSV RSA SHA MD UTF ID IP TCP UDP USB GPS CSS PHP AWS DB UI IO VM CPU GPU RAM HTTP HTTPS FTP SSH TLS SSL DNS UUID".split()


def syllables(draw: random.Random) -> str:
    """A word of one to four syllables."""
    return "".join(draw.choice(ONSETS) + draw.choice(NUCLEI) + draw.choice(CODAS) for _ in range(draw.choice([1, 1, 2, 2, 2, 3, 3, 4])))


def identifiers(n: int = 16000, seed: int = 12) -> list[str]:
    """Labelled samples: words joined as in code, paths, addresses and file names; half of the words are from the list, most others
    made of syllables, so that words of other languages and of new things are met too, and some are capitals."""
    draw, out = random.Random(seed), []

    def word() -> str:
        of = draw.random()
        return draw.choice(SHORT) if of < 0.1 else syllables(draw) if of < 0.5 else draw.choice(NAME_WORDS) + draw.choice(["", "", "", "s", "ed", "ing"])

    for _ in range(n):
        words, style = [word() for _ in range(draw.randint(1, 5))], draw.randrange(6)
        if style == 1:
            words = [w.upper() for w in words]
        elif style in (0, 2):  # each with a capital, or all but the first
            words = [w.capitalize() if w.islower() and (i or not style) else w for i, w in enumerate(words)]
        if draw.random() < 0.3:
            words[draw.randrange(len(words))] += str(draw.randrange(10 ** draw.choice([1, 1, 2, 3])))
        joined = draw.choice(["_", "-", "/", "", "", "="] if style in (0, 2) else ["_", "-", "/", "", "="]).join(words)
        number = "".join(draw.choice("-/_") + str(draw.randrange(10 ** draw.randint(1, 4))).zfill(draw.choice([1, 2])) for _ in range(draw.randint(1, 3)))
        out.append(joined + draw.choice(["", "", "1", "2", "10", "_v2", "2024", "00", number, number]))
    return out


class Markov:
    """Log-likelihood ratio of random against identifier for the next character, given ``order`` before it."""

    def __init__(self, positives: Iterable[str], negatives: Iterable[str], order: int = 2, smooth: float = 5.0):
        self.order, size = order, len(_ALPHABET)
        tables = []
        for sample in (positives, negatives):
            table = np.full((1, size), 1 / size)
            for n in range(order + 1):  # contexts of n characters back off to those of n - 1
                counts = np.zeros((size**n, size))
                for x in sample:
                    codes = _CODE[np.frombuffer(x.encode(), np.uint8)]
                    codes = codes[codes >= 0]
                    if len(codes) > n:
                        np.add.at(counts, (self._context(codes, n), codes[n:]), 1)
                shorter = np.tile(table, (len(counts) // len(table), 1))  # row c of n characters ends in row c % size**(n-1)
                table = (counts + smooth * shorter) / (counts.sum(1, keepdims=True) + smooth)
            tables.append(np.log(table))
        self.ratio = (tables[0] - tables[1]).astype(np.float32)

    def _context(self, codes: np.ndarray, order: int) -> np.ndarray:
        at = np.zeros(len(codes) - order, np.int64)
        for i in range(order):
            at = at * len(_ALPHABET) + codes[i : len(codes) - order + i]
        return at

    def score(self, run: bytes) -> float:
        """Sum over the run, in nats."""
        codes = _CODE[np.frombuffer(run, np.uint8)]
        return float(self.ratio[self._context(codes, self.order), codes[self.order :]].sum())


@functools.cache
def trained() -> Markov:
    """The two models, from samples that are the same everywhere; trained once, by the driver, and handed out."""
    return Markov(random_strings(), identifiers())


def _runs(data: bytes) -> list[tuple[int, int]]:
    buf = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = _TOKEN[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[0::2], edge[1::2]
    long = ends - starts >= RUN
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def scan(data: bytes, model: Markov, margin: float = 8.0) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points."""
    found: list[tuple[int, int, int]] = []  # start, kind, end in bytes
    low = data.lower()
    if any(n in low for n in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data) if m.end(2) - m.start(2) >= LEAST["assign"]]
    runs = _runs(data) if len(data) >= RUN else []
    for start, end in runs:  # both patterns match within one run only
        for kind, pattern in ((1, ACCESS), (2, HEX)):
            found += [(m.start(), kind, m.end()) for m in pattern.finditer(data, start, end) if m.end() - m.start() >= LEAST[KINDS[kind]]]
    base = sorted((s, e) for s, _, e in found)
    for start, end in runs:
        run = data[start:end].strip(b"=-/+_")
        if len(run) < RUN or not _MIXED.search(run):
            continue
        parts = [x for x in re.split(rb"[=/_-]", run) if PART <= len(x) < len(run) and _MIXED.search(x)]
        if any(model.score(x) > margin for x in (run, *parts)) and not any(s < end and start < e for s, e in base):
            at = data.index(run, start)
            found.append((at, 3, at + len(run)))
    if not found:
        return []
    found.sort()
    if len(data) == len(data.decode("utf-8", "replace")):
        return [(KINDS[k], s, e) for s, k, e in found]
    points = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
    return [(KINDS[k], int(points[s]), int(points[e])) for s, k, e in found]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_secrets(df: DataFrame, text_col: str = "text", out_col: str = "secrets", margin: float = 8.0) -> DataFrame:
    """``df`` with an array of (kind, start, end); the other columns stay in the JVM."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    shared = df.sparkSession.sparkContext.broadcast(trained())  # 1.2 MB, whatever the data

    @F.arrow_udf(SPANS)
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for texts in parts:
            yield pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in scan(t, model, margin)] for t in texts_of(texts)], kind)

    return df.withColumn(out_col, run(F.col(text_col)))


def redact(df: DataFrame, text_col: str = "text", spans_col: str = "secrets") -> DataFrame:
    """``df`` with each span, or run of overlapping spans, replaced by ``[kind]`` of its first."""
    start = F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc, s):
        to = F.greatest(acc["at"], s["end"] + 1)
        kept = F.when(s["start"] + 1 >= acc["at"], F.array(F.substr(F.col(text_col), acc["at"].cast("int"), (s["start"] + 1 - acc["at"]).cast("int")), F.concat(F.lit("["), s["kind"], F.lit("]"))))
        return F.struct(to.alias("at"), F.concat(acc["parts"], F.coalesce(kept, F.array().cast("array<string>"))).alias("parts"))

    def finish(acc):
        return F.concat(F.array_join(acc["parts"], ""), F.substr(F.col(text_col), acc["at"].cast("int")))

    clean = F.when(F.size(spans_col) > 0, F.aggregate(spans_col, start, step, finish)).otherwise(F.col(text_col))
    return df.withColumn(text_col, clean)
