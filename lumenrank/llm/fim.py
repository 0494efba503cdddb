"""Fill-in-the-middle examples: a text cut at two units and put together in another order.

Units are words with the white space before them; white space at the end of a text is a unit of its
own. Of each text only the units' ends are kept, eight bytes a unit, and two look-ups among them slice it. Where it is cut
and which form it takes comes from a digest of seed and id, so a rerun cuts alike. A text that is empty or has one
of the marks in it, and those not drawn, stay as they are ("plain"); so each mark of another form is there once, and
``restore`` finds the text again without being told the cuts.

Rows: null text counts as empty; a null id is drawn for as an empty one; rows repeating an id are cut by the
same draws, each on its own text; an empty table gives none; columns of the names given for output are
replaced, all others stay, whatever they are called.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = regex.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Marks:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __iter__(self) -> Iterator[str]:
        return iter((self.prefix, self.suffix, self.middle))


def unit_ends(text: str) -> array:
    """Where each unit ends, behind a 0."""
    return array("q", [0, *(m.end() for m in UNIT.finditer(text))])


def draws(seed: int, key: str) -> list[int]:
    """Four unsigned numbers of 32 bits from the digest of seed and key."""
    found = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(found[i : i + 8], 16) for i in range(0, 32, 8)]


def cut(text: str, key: str, seed: int, rate: int, spm_rate: int, marks: Marks) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of prefix, of middle, the example); rates are percentages."""
    ends = unit_ends(text)
    n = len(ends) - 1
    h1, h2, h3, h4 = draws(seed, key)
    if not text or h3 % 100 >= rate or any(m in text for m in marks):
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends[first], ends[second]
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    spm = h4 % 100 < spm_rate
    head = f"{marks.suffix}{suffix}{marks.prefix}{prefix}" if spm else f"{marks.prefix}{prefix}{marks.suffix}{suffix}"
    return n, "spm" if spm else "psm", a, b - a, f"{head}{marks.middle}{middle}"


def rebuilt(example: str, form: str, marks: Marks) -> str:
    """The text of an example; ValueError if its marks do not fit the form."""
    if form == "plain":
        return example
    first, second = (marks.suffix, marks.prefix) if form == "spm" else (marks.prefix, marks.suffix)
    head, found, middle = example.partition(marks.middle)
    a, parted, b = head.removeprefix(first).partition(second)
    if not (found and parted and head.startswith(first)):
        raise ValueError(f"no example of form {form}")
    return b + middle + a if form == "spm" else a + middle + b


def _checked(marks: Marks) -> Marks:
    """Marks that what stands beside them can neither make nor hide."""
    if any(not m or any(o[0] in m[1:] for o in marks) or sum(o.startswith(m) for o in marks) > 1 for m in marks):
        raise ValueError("a mark must open with a character that no mark goes on with, and no other mark")
    return marks


_OUT = "units long, form string, prefix_chars long, middle_chars long, example string, digest string"


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "fim", seed: int = 42, rate: int = 50, spm_rate: int = 80, marks: Marks | None = None) -> DataFrame:
    """``df`` with a struct (units, form, prefix_chars, middle_chars, example, digest): lengths in code points, null if plain;
    digest is the lower-case SHA-256 of the example. ``rate`` percent of the texts are cut, ``spm_rate`` percent of
    those with the suffix first."""
    marks = _checked(marks or Marks())

    @F.pandas_udf(_OUT)
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for keys, texts in parts:
            rows = [cut(t or "", k or "", seed, rate, spm_rate, marks) for k, t in zip(keys, texts, strict=True)]
            out = pd.DataFrame(rows, columns=["units", "form", "prefix_chars", "middle_chars", "example"])
            lengths = {c: out[c].astype("Int64") for c in ("prefix_chars", "middle_chars")}
            yield out.assign(**lengths, digest=[hashlib.sha256(r[4].encode()).hexdigest() for r in rows])

    return df.withColumn(out_col, run(F.col(id_col).cast("string"), F.col(text_col)))


def restore(example: Column, form: Column, marks: Marks | None = None) -> Column:
    """The text that ``fill_in_middle`` made an example of; null of a null."""
    marks = _checked(marks or Marks())

    @F.pandas_udf("string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for examples, forms in parts:
            yield pd.Series([None if e is None or f is None else rebuilt(e, f, marks) for e, f in zip(examples, forms, strict=True)], dtype=object)

    return run(example, form)
