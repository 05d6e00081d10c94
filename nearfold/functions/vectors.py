"""Vector functions on arrays, within code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantized(v: Column, scale: int) -> Column:
    """floor(v * scale + 1/2) of each element as long: exact in later sums."""
    return F.transform(v, lambda x: F.floor(x.cast("double") * scale + 0.5))


def l2sqr(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda s, x: s + x)


def logscale(v: Column, floor: float) -> Column:
    """Logarithm of each element above ``floor``, scaled to 0..1."""
    low = math.log(floor)
    return F.transform(v, lambda x: F.least(F.lit(1.0), (F.log(F.greatest(x.cast("double"), F.lit(floor))) - low) / -low))


def descriptor_scale(v: Column) -> Column:
    return F.transform(v, lambda x: F.least(F.lit(1.0), x.cast("double") * 2))


def binarify(v: Column, threshold: float) -> Column:
    """Bit i (least significant first) is set where element i reaches the threshold; at most 62 elements."""
    bits = F.transform(v, lambda x, i: F.when(x.cast("double") >= threshold, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s + x)


def off_by_one(a: Column, b: Column) -> Column:
    """Elements that differ by exactly one; null where any differs by more."""
    d = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return F.when(F.array_max(d) <= 1, F.aggregate(d, F.lit(0).cast("long"), lambda s, x: s + x))


def lsh_bit(v: Column, j: int, width: int) -> Column:
    """Low bit of the j-th integer projection of a quantized vector; the projection is a fixed formula."""
    total = F.aggregate(F.transform(v, lambda x, i: x * (F.pmod(i * 31 + F.lit(j * 17) + i * i, F.lit(101)) - 50)), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.floor((total + 37 * j) / F.lit(float(width))).bitwiseAND(F.lit(1).cast("long"))
