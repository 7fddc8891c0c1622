"""Scalar rules: element types, saturating casts, half-even rounding, activations, 2-D vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Element type: lowest value, highest value, Spark type that holds it (Spark has no unsigned types).
TYPES = {
    "U8": (0, 255, "smallint"),
    "S8": (-128, 127, "tinyint"),
    "U16": (0, 65535, "int"),
    "S16": (-32768, 32767, "smallint"),
    "U32": (0, 4294967295, "bigint"),
    "S32": (-2147483648, 2147483647, "int"),
}


def sat(v: Column, kind: str) -> Column:
    """Saturating cast: round half to even, then clamp. Floats pass through as doubles."""
    if kind in ("F16", "F32", "F64"):
        return v.cast("double")
    lo, hi, spark = TYPES[kind]
    return F.least(F.greatest(F.bround(v.cast("double"), 0), F.lit(float(lo))), F.lit(float(hi))).cast(spark)


def clamp(v: Column, lo, hi) -> Column:
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))


def nearly_equal(a: Column, b: Column, eps: float = 1e-6) -> Column:
    return F.abs(a - b) < eps


def rounded(v: Column, digits: int) -> Column:
    """round(v, digits) of a double, bit for bit; in plain arithmetic unless a tie is near (F.round makes a decimal of each value)."""
    y = v * 10.0**digits
    n = F.rint(y)
    return F.when((F.abs(y) < 2.0**40) & (F.abs(y - n) < 0.499), n / 10.0**digits + 0.0).otherwise(F.round(v, digits))


def sigmoid(v: Column) -> Column:
    return 1 / (1 + F.exp(-v))


def silu(v: Column) -> Column:
    return v * sigmoid(v)


def hardswish(v: Column) -> Column:
    return v * F.least(F.greatest(v + 3, F.lit(0.0)), F.lit(6.0)) / 6


def mish(v: Column) -> Column:
    return v * F.tanh(F.log1p(F.exp(v)))


def acon(v: Column, p1: float, p2: float, beta: float) -> Column:
    d = v * (p1 - p2)
    return d * sigmoid(beta * d) + p2 * v


def length2d(x: Column, y: Column) -> Column:
    return F.hypot(x, y)


def angle2d(x: Column, y: Column) -> Column:
    return F.atan2(y, x)


def cross2d(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def inner2d(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * bx + ay * by


def rotate2d(x: Column, y: Column, angle: float) -> tuple[Column, Column]:
    import math

    c, s = math.cos(angle), math.sin(angle)
    return x * c - y * s, x * s + y * c
