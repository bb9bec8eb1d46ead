"""Seeded random draws as columns: the i-th number of a seed's sequence, without the ones before it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The step of the generator's state, and what its output is divided by.
STEP, RANGE = 0x6D2B79F5, 1 << 32
_LOW = (1 << 32) - 1


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_LOW))


def _times(x: Column, y: Column) -> Column:
    """The low 32 bits of a product of two numbers of 32 bits, by halves, so that no long overflows."""
    high = _low(x * F.shiftright(y, 16))
    return _low(x * y.bitwiseAND(F.lit(0xFFFF)) + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16))


def draw(seed: Column, i: Column) -> Column:
    """The i-th draw (from 1) of a 32-bit seed, in [0, 1). The state only ever moves by STEP, so it is a product, and draws of one seed are independent of each other."""
    index = _low(i.cast("long"))
    a = _low(_low(seed.cast("long")) + _times(F.lit(STEP).cast("long"), index))
    t = _times(a.bitwiseXOR(F.shiftrightunsigned(a, 15)), a.bitwiseOR(F.lit(1)))
    t = t.bitwiseXOR(_low(t + _times(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61)))))
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)) / F.lit(float(RANGE))


def pick(seed: Column, i: Column, n: Column) -> Column:
    """The i-th draw as a whole number from 0 to n - 1."""
    return F.floor(draw(seed, i) * n).cast("long")
