"""Deterministic draws: a 32-bit hash of a text, a small generator and a shuffle seeded by it.

Fixed values: the offset and prime of FNV-1a, and the constants of mulberry32.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
STEP = 0x6D2B79F5
_MASK = 0xFFFFFFFF


def _units(s: Column) -> Column:
    """UTF-16 code units of a text."""
    points = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    pair = lambda p: F.array(F.lit(0xD800) + F.shiftright(p - 0x10000, 10), F.lit(0xDC00) + (p - 0x10000).bitwiseAND(0x3FF))
    return F.flatten(F.transform(points, lambda p: F.when(p > 0xFFFF, pair(p)).otherwise(F.array(p))))


def fnv1a(s: Column) -> Column:
    """Unsigned 32-bit FNV-1a of a text's code units, as a long."""
    return F.aggregate(_units(s), F.lit(FNV_OFFSET).cast("long"), lambda h, c: (h.bitwiseXOR(c) * FNV_PRIME).bitwiseAND(_MASK))


def _times(a: Column, b: Column) -> Column:
    """Low 32 bits of a product, in two halves so that nothing overflows."""
    high = (F.shiftrightunsigned(a, 16) * b).bitwiseAND(0xFFFF)
    return (F.shiftleft(high, 16) + a.bitwiseAND(0xFFFF) * b).bitwiseAND(_MASK)


def draw(seed: Column, nth: int = 1) -> Column:
    """The nth number in [0, 1) of mulberry32 from a 32-bit seed."""
    a = (seed.cast("long") + F.lit(STEP * nth).cast("long")).bitwiseAND(_MASK)
    t = _times(a.bitwiseXOR(F.shiftrightunsigned(a, 15)), a.bitwiseOR(1))
    t = t.bitwiseXOR((t + _times(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(61))).bitwiseAND(_MASK))
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)) / F.lit(float(1 << 32))


def shuffled(items: list, seed: int) -> list:
    """Items swapped from the last down with one drawn at or before it."""
    out, a = list(items), seed & _MASK
    for i in range(len(out) - 1, 0, -1):
        a = (a + STEP) & _MASK
        t = ((a ^ a >> 15) * (a | 1)) & _MASK
        t ^= (t + ((t ^ t >> 7) * (t | 61) & _MASK)) & _MASK
        j = (t ^ t >> 14) * (i + 1) >> 32
        out[i], out[j] = out[j], out[i]
    return out


@F.arrow_udf(ArrayType(StringType()))
def seeded_shuffle(items: pa.Array, seeds: pa.Array) -> pa.Array:
    """An array of texts in the order that a seed gives."""
    return pa.array([None if x is None or s is None else shuffled(x, s) for x, s in zip(items.to_pylist(), seeds.to_pylist(), strict=True)], pa.list_(pa.string()))
