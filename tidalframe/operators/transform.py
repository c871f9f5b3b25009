"""Linear transforms as matrix products of Arrow batches, and windows as expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _product(kernel: np.ndarray):
    @F.pandas_udf("array<double>")
    def product(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(np.stack(batch.to_numpy()) @ kernel)) if len(batch) else pd.Series([], dtype=object)

    return product


def imdct(x: Column, lines: int) -> Column:
    """2 N samples of N lines: sum of X[k] cos(pi/N (n + 1/2 + N/2) (k + 1/2)). The kernel is N by 2 N, fixed by N."""
    k, n = np.arange(lines)[:, None] + 0.5, np.arange(2 * lines)[None, :] + 0.5 + lines / 2
    return _product(np.cos(np.pi / lines * n * k))(x)


def dct4(x: Column, lines: int) -> Column:
    k = np.arange(lines) + 0.5
    return _product(np.cos(np.pi / lines * k[:, None] * k[None, :]))(x)


def mdct(x: Column, lines: int) -> Column:
    """N lines of 2 N samples, scaled by the root of 2/N, under a sine window."""
    k, n = np.arange(lines)[None, :] + 0.5, np.arange(2 * lines)[:, None] + 0.5
    window = np.sin(np.pi / (2 * lines) * n)
    return _product(window * np.cos(np.pi / lines * (n + lines / 2) * k) * np.sqrt(2 / lines))(x)


def short_blocks(x: Column, lines: int, shorts: int) -> Column:
    """2 N samples of N lines in ``shorts`` runs: each run's short transform under its sine window, side by side in the middle.

    All of it is one linear map of a frame, so it is one matrix product.
    """
    m = lines // shorts
    k, n = np.arange(m)[:, None] + 0.5, np.arange(2 * m)[None, :] + 0.5
    block = np.cos(np.pi / m * (n + m / 2) * k) * np.sin(np.pi / (2 * m) * n)
    kernel = np.zeros((lines, 2 * lines))
    for i in range(shorts):
        at = (lines - m) // 2 + i * m
        kernel[i * m : (i + 1) * m, at : at + 2 * m] = block
    return _product(kernel)(x)


def sine_shape(i: Column, n: int) -> Column:
    """Point ``i`` of a sine window of ``n`` points."""
    return F.sin(F.lit(np.pi / n) * (i + 0.5))


def power_shape(i: Column, n: int) -> Column:
    """Point ``i`` of a power-complementary window of ``n`` points: a sine of a squared sine."""
    return F.sin(F.lit(np.pi / 2) * F.pow(sine_shape(i, n), F.lit(2.0)))


def switched_window(sequence: Column, i: Column, lines: int, shorts: int, before, now) -> Column:
    """Point ``i`` of the window of 2 N points for a ``sequence``: long, start (ends in a short slope) or stop (begins with one); else null.

    ``before`` shapes the rising half, ``now`` the falling one.
    """
    m = lines // shorts
    low = (lines - m) // 2
    rise, fall = before(i, 2 * lines), now(i, 2 * lines)
    start = F.when(i < lines + low, 1.0).when(i < lines + low + m, now(i - (lines + low - m), 2 * m)).otherwise(0.0)
    stop = F.when(i < low, 0.0).when(i < low + m, before(i - low, 2 * m)).otherwise(1.0)
    return F.when(i < lines, F.when(sequence.isin("long", "start"), rise).when(sequence == "stop", stop)).otherwise(F.when(sequence.isin("long", "stop"), fall).when(sequence == "start", start))


def control_gain(control: Column, cut: float, boost: float, target: Column, level: Column) -> Column:
    """The gain of a control byte: its low bits in 24ths of an octave, cut if the top bit is set, else boosted; moved from ``level`` to ``target`` where both are known."""
    scale = F.when(control >= 128, -cut).otherwise(boost)
    moved = F.coalesce(F.pow(F.lit(2.0), -(target - level) / 24.0), F.lit(1.0))
    return F.pow(F.lit(2.0), scale * (control % 128) / 24.0) * moved


def concealed_scale(kind: Column, gain: Column, noise: Column) -> Column:
    """What a lost scale of a section's ``kind`` becomes: one value for all spectral ones, one for noise, one for intensity.

    Fixed values: kinds 0 and 12 are empty, 13 is noise, 14 and 15 are intensity; offsets 100 and 246.
    """
    return F.when(kind.isin(0, 12), 0).when(kind == 13, gain - 246 + F.coalesce(noise, F.lit(0))).when(kind.isin(14, 15), -100).otherwise(gain - 100).cast("int")


def sine_window(spark: SparkSession, n: int) -> DataFrame:
    """(i, w): sin(pi/n (i + 1/2))."""
    return spark.range(n).select(F.col("id").alias("i"), F.sin(F.lit(np.pi / n) * (F.col("id") + 0.5)).alias("w"))


def kaiser_window(spark: SparkSession, n: int, alpha: float) -> DataFrame:
    """(i, w): root of the running share of a Kaiser kernel of n + 1 points; the Bessel function by its series."""
    arm = 2.0 * F.col("id") / n - 1.0
    z = F.lit(np.pi * alpha / 2) * F.sqrt(1.0 - arm * arm)
    terms = F.transform(F.sequence(F.lit(0), F.lit(40)), lambda k: F.pow(z, k.cast("double")) / F.factorial(F.least(k, F.lit(20))) / F.when(k > 20, F.aggregate(F.sequence(F.lit(21), F.greatest(k, F.lit(21))), F.lit(1.0), lambda a, b: a * b)).otherwise(1.0))
    value = F.aggregate(terms, F.lit(0.0), lambda a, t: a + t * t)
    rows = spark.range(n + 1).withColumn("k", value)
    total = F.sum("k").over(Window.partitionBy())
    run = F.sum("k").over(Window.orderBy("id"))
    return rows.select(F.col("id").alias("i"), F.sqrt(run / total).alias("w")).where(F.col("i") < n)
