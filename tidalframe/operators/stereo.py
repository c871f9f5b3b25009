"""Channel recombination: pairs of channels meet in one aggregation, never in a self-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paired(spectrum: DataFrame) -> DataFrame:
    """(frame, line, a, b): both channels of a line, null where a channel lacks it."""
    of = lambda ch: F.max(F.when(F.col("ch") == ch, F.col("v")))
    return spectrum.groupBy("frame", "line").agg(of(0).alias("a"), of(1).alias("b"))


def mid_side(pairs: DataFrame, used: Column, scale: float) -> DataFrame:
    """(frame, line, l, r): sum and difference times ``scale`` where ``used``, else the channels as they are."""
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    return pairs.select("frame", "line", F.when(used, (a + b) * scale).otherwise(a).alias("l"), F.when(used, (a - b) * scale).otherwise(b).alias("r"))


def intensity(pairs: DataFrame, used: Column, scale: Column) -> DataFrame:
    """(frame, line, l, r): the right channel is the left one times ``scale`` where ``used``."""
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    return pairs.select("frame", "line", a.alias("l"), F.when(used, a * scale).otherwise(b).alias("r"))


def predicted_side(pairs: DataFrame, real: float, imaginary: float) -> DataFrame:
    """(frame, line, l, r): the side is predicted from the mid and half the difference of its neighbours.

    Before a frame's first line stands the last line of the frame before.
    """
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    rows = pairs.select("frame", "line", a.alias("a"), b.alias("b"), ((a + b) * 0.5).alias("m"))
    own = Window.partitionBy("frame").orderBy("line")
    ends = rows.groupBy("frame").agg(F.max_by("m", "line").alias("last")).select((F.col("frame") + 1).alias("frame"), "last")
    rows = rows.join(ends, "frame", "left")
    before = F.coalesce(F.lag("m").over(own), "last", F.lit(0.0))
    after = F.coalesce(F.lead("m").over(own), F.lit(0.0))
    side = F.col("b") - F.lit(real) * F.col("m") - F.lit(imaginary) * (after - before) * 0.5
    return rows.select("frame", "line", (F.col("a") + side).alias("l"), (F.col("a") - side).alias("r"))


def cues(pairs: DataFrame, groups: int, lines: int) -> DataFrame:
    """(frame, grp, level, correlation): rounded level difference and eighths of the correlation.

    Neighbouring lines are the real and imaginary parts of one complex value.
    """
    half = Window.partitionBy("frame").orderBy("line")
    complex_ = pairs.withColumns({"ai": F.lead("a").over(half), "bi": F.lead("b").over(half)}).where("line % 2 = 0")
    grp = F.floor(F.col("line") * groups / lines).cast("int")
    sums = complex_.groupBy("frame", grp.alias("grp")).agg(
        F.sum(F.expr("a*a + ai*ai")).alias("el"),
        F.sum(F.expr("b*b + bi*bi")).alias("er"),
        F.sum(F.expr("a*b + ai*bi")).alias("xr"),
        F.sum(F.expr("ai*b - a*bi")).alias("xi"),
    )
    level = F.round(1.5 * F.log2((F.col("el") + 1e-20) / (F.col("er") + 1e-20)))
    level = F.when(F.col("el") + F.col("er") <= 2.220446049250313e-16, 0).otherwise(F.greatest(F.lit(-7.0), F.least(F.lit(7.0), level))).cast("int")
    norm = F.sqrt(F.col("el") * F.col("er"))
    link = F.when(norm <= 2.220446049250313e-16, 1.0).otherwise(F.least(F.lit(1.0), F.sqrt(F.col("xr") * F.col("xr") + F.col("xi") * F.col("xi")) / norm))
    return sums.select("frame", "grp", level.alias("level"), F.round(link, 6).alias("correlation"))


def matrix_mix(samples: DataFrame, gains: DataFrame) -> DataFrame:
    """(t, dst, v): samples (t, src, v) through a matrix (src, dst, gain), a fixed dimension of layouts.

    Sources that the matrix lacks play no part.
    """
    return samples.join(F.broadcast(gains), "src").groupBy("t", "dst").agg(F.sum(F.col("v") * F.col("gain")).alias("v"))


def extended(samples: DataFrame, layout: DataFrame) -> DataFrame:
    """(t, ord, label, v, padded): samples (t, label, v) placed in a layout (ord, label), a fixed dimension; silence where missing."""
    slots = layout.agg(F.collect_list(F.struct("ord", "label")).alias("slots"))
    frames = samples.groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("label", "v"))).alias("m"))
    rows = frames.join(F.broadcast(slots)).select("t", "m", F.inline("slots"))
    value = F.try_element_at("m", F.col("label"))
    return rows.select("t", "ord", "label", F.coalesce(value, F.lit(0.0)).alias("v"), value.isNull().alias("padded"))
