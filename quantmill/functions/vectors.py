"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalise(a: Column, eps: float = 1e-9) -> Column:
    length = norm(a)
    return F.transform(doubles(a), lambda x: x / F.greatest(length, F.lit(eps)))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def bucket(x: Column, cutoffs: list[float]) -> Column:
    """How many cutoffs lie strictly below x."""
    return sum((F.when(F.lit(float(c)) < x, 1).otherwise(0) for c in cutoffs), F.lit(0))


def pack_bits(buckets: Column, bits: int) -> Column:
    """Bucket numbers of ``bits`` bits each as bytes, the first in the lowest bits."""
    per = 8 // bits
    size = F.ceil(F.size(buckets) / F.lit(per)).cast("int")

    def byte(i: Column) -> Column:
        part = F.slice(buckets, i * per + 1, F.lit(per))
        shifted = F.transform(part, lambda x, j: x * F.pow(F.lit(2.0), j * bits).cast("int"))
        return F.aggregate(shifted, F.lit(0), lambda s, x: s + x.cast("int")).cast("smallint")

    return F.transform(F.sequence(F.lit(0), size - 1), byte)


def unpack_bits(packed: Column, bits: int, n: int) -> Column:
    per, mask = 8 // bits, (1 << bits) - 1
    flat = F.flatten(F.transform(packed, lambda x: F.array(*[F.shiftright(x.cast("int"), j * bits).bitwiseAND(F.lit(mask)) for j in range(per)])))
    return F.slice(flat, 1, n)


def saturate(x: Column) -> Column:
    """ln(1 + max(x, 0))."""
    return F.log1p(F.greatest(x, F.lit(0.0)))
