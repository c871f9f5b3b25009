"""Borders, upmixing, exact integer steps and thresholds that follow how noise-like a frame is."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fold import ordered_scan
from .records import with_value

#: Fixed values of the limiter's borders: borders an octave by setting, least share of an octave.
DENSITIES, LEAST_OCTAVE = (1.0, 1.2, 2.0, 3.0), 0.49
#: Fixed values of the upmix: level differences in dB from index -15 on, correlations from index 0 on.
LEVELS_DB = (-150.0, -45.0, -40.0, -35.0, -30.0, -25.0, -22.0, -19.0, -16.0, -13.0, -10.0, -8.0, -6.0, -4.0, -2.0, 0.0, 2.0, 4.0, 6.0, 8.0, 10.0, 13.0, 16.0, 19.0, 22.0, 25.0, 30.0, 35.0, 40.0, 45.0, 150.0)
CORRELATIONS = (1.0, 0.937, 0.84118, 0.60092, 0.36764, 0.0, -0.589, -0.99)
#: Fixed values of the integer steps: quarter octaves in 16.16, largest result.
QUARTERS, LARGEST = (65_536, 77_936, 92_682, 110_218), 2**31 - 1
#: Fixed values of the variable-rate thresholds: weights of the new measure and the old, its map to the share, least threshold, measure before the first frame.
TAKEN, KEPT, CENTRE, SLOPE, SHARE_BOUNDS, FORM_SCALE = 0.25, 0.75, 0.2, 0.7 / 0.3, (0.1, 1.0), 4.0
LEAST_THRESHOLD, CHAOS_BEFORE = 2.0**-33, 0.3


def limiter_borders(low: Column, patches: Column, setting: Column) -> Column:
    """The borders of a limiter: those of ``low`` and ``patches`` (sorted arrays) that lie far enough apart.

    Of two close borders the upper one goes unless it is a patch's; then the lower one goes unless it is a
    patch's, too, or the first. Setting 0 has the outer two only.
    """
    ends = F.array(low[0], F.element_at(low, -1))
    known = F.array_append(patches, F.element_at(low, -1))
    rest = F.array_sort(F.array_distinct(F.concat(low, known)))
    density = F.get(F.array(*[F.lit(d) for d in DENSITIES]), setting)

    def joined(kept: Column, border: Column) -> Column:
        last = F.element_at(kept, -1)
        close = density * F.log2(border / last) < LEAST_OCTAVE
        before = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        out = F.when(close & ~F.array_contains(known, border), kept)
        out = out.when(close & ~F.array_contains(known, last) & (F.size(kept) > 1), F.array_append(before, border))
        return out.otherwise(F.array_append(kept, border))

    return F.when(setting == 0, ends).otherwise(with_value(rest, lambda b: F.aggregate(F.slice(b, 2, F.greatest(F.size(b) - 1, F.lit(0))), F.slice(b, 1, 1), joined)))


def upmixed(direct: tuple[Column, Column], diffuse: tuple[Column, Column], level: Column, correlation: Column, phase: Column) -> Column:
    """Two complex channels of one and its decorrelated twin, from the indices of level, correlation and phase (null: none).

    The levels keep the sum of powers; the second channel is turned by eighths of half a turn. Indices beyond the tables count as their ends.
    """
    db = F.get(F.array(*[F.lit(v) for v in LEVELS_DB]), F.least(F.greatest(level, F.lit(-15)), F.lit(15)) + 15)
    like = F.get(F.array(*[F.lit(v) for v in CORRELATIONS]), F.least(F.greatest(correlation, F.lit(0)), F.lit(7)))
    ratio = F.pow(F.lit(10.0), db / 10.0)
    near, far = F.sqrt((1.0 + like) / 2.0), F.sqrt((1.0 - like) / 2.0)
    left, right = F.sqrt(ratio / (1.0 + ratio)), F.sqrt(1.0 / (1.0 + ratio))
    angle = F.coalesce(phase, F.lit(0)).bitwiseAND(F.lit(15)) * (math.pi / 8.0)
    re, im = (right * (near * direct[k] - far * diffuse[k]) for k in (0, 1))
    return F.struct(
        (left * (near * direct[0] + far * diffuse[0])).alias("l_re"),
        (left * (near * direct[1] + far * diffuse[1])).alias("l_im"),
        (re * F.cos(angle) - im * F.sin(angle)).alias("r_re"),
        (re * F.sin(angle) + im * F.cos(angle)).alias("r_im"),
    )


def reflection(resolution: Column, index: Column) -> Column:
    """The reflection coefficient of an index of 3 or 4 bits: a sine, of a slightly wider step below zero; 0 at other resolutions."""
    steps = F.pow(F.lit(2.0), resolution) + F.when(index < 0, 1).otherwise(-1)
    return F.when(resolution.isin(3, 4), F.sin(index * math.pi / steps)).otherwise(0.0)


def integer_step(level: Column, scale: Column) -> Column:
    """``level`` to the power 4/3 times 2 to a quarter of ``scale``, in integers throughout; saturates at 31 bits.

    The power is a whole cube root with 16 fractional bits: a root in floating point is put right by exact
    cubes. Levels up to 8,191 in size; halves round up in size.
    """
    size = F.abs(level).cast("decimal(10,0)")
    target = (size * size * size * size).cast("decimal(22,0)") * F.lit(2**48).cast("decimal(15,0)")
    guess = F.floor(F.cbrt(target.cast("double"))).cast("decimal(11,0)")

    def rooted(x: Column) -> Column:
        cube = lambda r: (r * r).cast("decimal(22,0)") * r
        up, down = (x["g"] + 1).cast("decimal(11,0)"), (x["g"] - 1).cast("decimal(11,0)")
        return F.when(cube(up) <= x["t"], up).when(cube(x["g"]) <= x["t"], x["g"]).otherwise(down).cast("long")

    root = with_value(F.struct(guess.alias("g"), target.alias("t")), rooted)
    scaled = root * F.get(F.array(*[F.lit(q).cast("long") for q in QUARTERS]), F.pmod(scale, F.lit(4)))
    up = F.floor(scale / 4).cast("int") - 1

    def shifted(v: Column) -> Column:
        left = F.call_function("shiftleft", v, F.least(up, F.lit(12)))
        large = (up > 12) | (v > F.call_function("shiftright", F.lit(LARGEST).cast("long"), F.least(F.greatest(up, F.lit(0)), F.lit(31))))
        half = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.least(-up, F.lit(62)) - 1, F.lit(0)))
        right = F.when(-up > 62, F.lit(0).cast("long")).otherwise(F.call_function("shiftright", v + half, F.least(-up, F.lit(62))))
        return F.when(up < 0, right).when(large, F.lit(LARGEST).cast("long")).otherwise(left)

    out = F.least(with_value(scaled, shifted), F.lit(LARGEST).cast("long"))
    return F.when(level == 0, 0).otherwise(F.signum(level.cast("double")).cast("long") * out).cast("int")


def variable_thresholds(bands: DataFrame, stream: str, frame: str, quality: float) -> DataFrame:
    """``bands`` (stream, frame, ch, band, width, energy, form, threshold, snr) with chaos and reduced.

    A channel's measure is four times its form factor over that of flat lines, of the bands above their threshold; a
    frame's is their mean weighted by energy, at most 1, and no more than its smoothed value, which goes on to the
    next frame. The thresholds' fourth roots rise by a share of the frame's energy, up to the band's least ratio.
    """
    loud = F.col("energy") > F.col("threshold")
    sums = lambda v: F.sum(F.when(loud, v).otherwise(0.0))
    channel = bands.groupBy(stream, frame, "ch").agg(F.sum(F.greatest("energy", F.lit(0.0))).alias("all"), sums(F.greatest("energy", F.lit(0.0))).alias("e"), sums(F.greatest("form", F.lit(0.0))).alias("f"), sums(F.col("width").cast("double")).alias("n"))
    measure = F.when((F.col("n") == 0) | (F.col("e") <= 0), 1.0).otherwise(FORM_SCALE * F.col("f") / F.pow(F.col("e") / F.col("n"), F.lit(0.25)) / F.col("n"))
    total = F.greatest(F.sum("all"), F.lit(1e-10))
    frames = channel.groupBy(stream, frame).agg(F.least(F.sum(measure * F.col("e")) / total, F.lit(1.0)).alias("measure"), total.alias("total"))

    def smoothed(old: float, row: tuple) -> tuple:
        now = min(row[0], TAKEN * row[0] + KEPT * old)
        return now, (now,)

    chaos = ordered_scan(frames, stream, [frame], ["measure", "total"], lambda: CHAOS_BEFORE, smoothed, [T.StructField("chaos", T.DoubleType())])
    low, high = SHARE_BOUNDS
    share = F.greatest(F.lit(low), F.least(F.lit(high), CENTRE + SLOPE * (F.col("chaos") - CENTRE)))
    rise = chaos.select(stream, frame, "chaos", (quality * share * F.pow("total", F.lit(0.25))).alias("__rise"))
    t, e = F.col("threshold"), F.col("energy")
    raised = F.pow(F.pow(t, F.lit(0.25)) + F.greatest("__rise", F.lit(0.0)), F.lit(4.0))
    most = e * F.col("snr")
    reduced = F.greatest(F.when(raised > most, F.greatest(most, t)).otherwise(raised), F.lit(LEAST_THRESHOLD))
    out = bands.join(rise, [stream, frame]).withColumn("reduced", F.when((e <= t) | (e <= 0) | (t < LEAST_THRESHOLD), t).otherwise(reduced))
    return out.drop("__rise")
