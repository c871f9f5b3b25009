"""Scalar functions on numbers and fixed-point values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Q31_MAX, Q31_MIN = 2**31 - 1, -(2**31)


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def dequantized(q: Column, scale: Column) -> Column:
    """sign(q) |q|^(4/3) 2^(scale/4)."""
    return F.signum(q.cast("double")) * F.pow(F.abs(q).cast("double"), F.lit(4.0 / 3.0)) * F.pow(F.lit(2.0), scale / 4.0)


def to_q31(x: Column) -> Column:
    """A double in [-1, 1) as 32-bit fixed point, rounded half away from zero and saturated; NaN and infinities give 0."""
    odd = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(odd, F.lit(0).cast("long")).otherwise(clamp(F.round(clamp(x, -1.0, 1.0) * F.lit(2.0**31)).cast("long"), Q31_MIN, Q31_MAX))


def mul_q31(a: Column, b: Column) -> Column:
    """(a b) >> 31, saturated."""
    return clamp(F.shiftright(a.cast("long") * b.cast("long"), 31), Q31_MIN, Q31_MAX)


def shifted_q31(x: Column, by: Column) -> Column:
    """x 2^by, saturated; negative ``by`` shifts right, which rounds down. by: -31 to 31."""
    up = F.call_function("shiftleft", x.cast("long"), F.greatest(by, F.lit(0)).cast("int"))
    down = F.call_function("shiftright", x.cast("long"), F.greatest(-by, F.lit(0)).cast("int"))
    return F.when(by >= 0, clamp(up, Q31_MIN, Q31_MAX)).otherwise(down)


def q31_to_pcm16(x: Column) -> Column:
    return F.shiftright(x.cast("long"), 16).cast("int")


def float_to_pcm16(x: Column) -> Column:
    """Rounded half away from zero, then clamped."""
    return clamp(F.round(x * 32768.0), -32768, 32767).cast("int")


def leading_zeros(x: Column) -> Column:
    """Leading zeros of a non-negative 32-bit number."""
    return F.when(x == 0, F.lit(32)).otherwise(32 - F.length(F.bin(x.cast("long"))))


def gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20.0)


def intensity_scale(position: Column, flipped: Column) -> Column:
    return F.when(flipped, -1.0).otherwise(1.0) * F.pow(F.lit(2.0), -0.25 * position)
