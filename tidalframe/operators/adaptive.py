"""Adaptive recurrences on ordered rows and small linear filters, most of them of audio origin."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fold import ordered_scan

#: Multipliers and increments of the two noise generators.
NOISE_GENERATORS = {"band": (1664525, 1013904223), "chunk": (69069, 5)}


def compressed(signal: DataFrame, attack: float, release: float, hold: int) -> DataFrame:
    """(stream, t, gain_db): a static curve of the level, then fast fall, held rise.

    The curve is 0 dB up to -20 dB and 1:2 above. A falling gain follows by ``attack`` of the way; a
    rising one waits ``hold`` rows and follows by ``release``.
    """

    def step(state: tuple, row: tuple) -> tuple:
        gain, waited = state
        level = 20.0 * np.log10(max(abs(row[0]), 1e-5))
        target = min(0.0, -0.5 * (float(level) + 20.0))
        if target < gain:
            gain, waited = gain + attack * (target - gain), 0
        elif waited < hold:
            waited += 1
        else:
            gain += release * (target - gain)
        return (gain, waited), (gain,)

    return ordered_scan(signal, "stream", ["t"], ["v"], lambda: (0.0, 0), step, [T.StructField("gain_db", T.DoubleType())]).select("stream", "t", "gain_db")


def weighted_energy(signal: DataFrame, pole: float) -> DataFrame:
    """(stream, energy): mean square behind a first-order high-pass y = x - x' + pole y'."""

    def step(state: tuple, row: tuple) -> tuple:
        y = row[0] - state[0] + pole * state[1]
        return (row[0], y), (y * y,)

    out = ordered_scan(signal, "stream", ["t"], ["v"], lambda: (0.0, 0.0), step, [T.StructField("e", T.DoubleType())])
    return out.groupBy("stream").agg(F.avg("e").alias("energy"))


#: Fixed values of the tracked range: shares by which it follows, and the least gap as a share of the value.
FOLLOW, LOWER, NARROW, GAP = 0.3, 0.14, 0.07, 6.0


def tracked_range(signal: DataFrame) -> DataFrame:
    """(stream, t, low, high): a range that follows the value.

    A value above it becomes its top and lifts its foot by FOLLOW of the excess; one below it moves the foot by
    LOWER and the top by NARROW of what is missing; one inside draws both ends in. A range narrower than a sixth
    of the value is set to that width, shared out as the value lay in it, from 0 on.
    """

    def step(state: tuple | None, row: tuple) -> tuple:
        v = row[0]
        low, high = state if state else (v, v)
        over, under = max(v - high, 0.0), max(low - v, 0.0)
        if under:
            low, high = low - LOWER * under, high - NARROW * under
        else:
            low, high = low + FOLLOW * (over or v - low), high + over - (0.0 if over else NARROW * (high - v))
        gap = v / GAP
        if high - low < gap:
            below, above = max(v - low, 0.0), max(high - v, 0.0)
            share = above / (below + above) if below + above > 0 else 0.5
            low, high = max(v - (1.0 - share) * gap, 0.0), v + share * gap
        return (low, high), (low, high)

    fields = [T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]
    return ordered_scan(signal, "stream", ["t"], ["v"], lambda: None, step, fields).select("stream", "t", "low", "high")


def onset_slots(energies: DataFrame, ratio: float) -> DataFrame:
    """(stream, t): the slot of each stream whose energy rises most over the one before, at least by ``ratio``; of equals the last."""
    order = Window.partitionBy("stream").orderBy("t")
    rise = F.col("e") / (F.lag("e").over(order) + 0.01)
    rows = energies.withColumn("rise", rise).where(F.col("rise") >= ratio)
    return rows.groupBy("stream").agg(F.max(F.struct("rise", "t"))["t"].alias("t"))


def line_tonality(spectra: DataFrame) -> DataFrame:
    """(ch, line, energy, tonality): of each line over the frames, its energy and normalised lag-1 correlation in [0, 1]."""
    order = Window.partitionBy("ch", "line").orderBy("frame")
    rows = spectra.withColumn("before", F.lag("v").over(order))
    both = F.col("before").isNotNull()
    x, e0, e1 = F.sum(F.when(both, F.col("v") * F.col("before"))), F.sum(F.when(both, F.col("v") * F.col("v"))), F.sum(F.when(both, F.col("before") * F.col("before")))
    norm = F.sqrt(e0 * e1)
    return rows.groupBy("ch", "line").agg(F.sum(F.col("v") * F.col("v")).alias("energy"), F.when(norm > 1e-30, F.least(F.lit(1.0), F.abs(x) / norm)).otherwise(0.0).alias("tonality"))


def lattice(x: Column, reflections: list[float]) -> Column:
    """All-pole lattice synthesis along an array, by Arrow batches: all rows of a batch move at once."""
    k = list(reflections)

    @F.pandas_udf("array<double>")
    def filtered(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if not len(batch):
                yield pd.Series([], dtype=object)
                continue
            rows = np.stack(batch.to_numpy()).astype(float)
            state = np.zeros((len(k), len(rows)))
            out = np.empty_like(rows)
            for t in range(rows.shape[1]):
                f = rows[:, t].copy()
                for i in range(len(k) - 1, -1, -1):
                    f -= k[i] * state[i]
                    if i + 1 < len(k):
                        state[i + 1] = state[i] + k[i] * f
                state[0] = f
                out[:, t] = f
            yield pd.Series(list(out))

    return filtered(x)


def noise(seed: Column, n: int, generator: str = "band") -> Column:
    """``n`` numbers of unit energy from a 32-bit linear congruential generator, equal for equal seeds."""
    a, c = NOISE_GENERATORS[generator]

    @F.pandas_udf("array<double>")
    def drawn(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            state = batch.to_numpy().astype(np.uint64) & np.uint64(0xFFFFFFFF)
            out = np.empty((len(state), n))
            for i in range(n):
                state = (state * np.uint64(a) + np.uint64(c)) & np.uint64(0xFFFFFFFF)
                out[:, i] = state.astype(np.uint32).view(np.int32)
            out /= np.sqrt((out * out).sum(axis=1, keepdims=True))
            yield pd.Series(list(out))

    return drawn(seed)


def patched(spectra: DataFrame, patches: DataFrame) -> DataFrame:
    """(frame, ch, line, v): lines copied to where ``patches`` (source, target, width) put them; a few fixed rows."""
    to = patches.select(F.explode(F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.struct((F.col("source") + i).alias("line"), (F.col("target") + i).alias("to")))).alias("p")).select("p.*")
    return spectra.join(F.broadcast(to), "line").select("frame", "ch", F.col("to").alias("line"), "v")


def followed_envelope(spectra: DataFrame, split: int) -> DataFrame:
    """(frame, ch, gain): of the lines from ``split`` on, following the power below it; a channel's high energy stays the same."""
    low = F.sum(F.when(F.col("line") < split, F.col("v") * F.col("v")).otherwise(0.0))
    high = F.sum(F.when(F.col("line") >= split, F.col("v") * F.col("v")).otherwise(0.0))
    powers = spectra.groupBy("frame", "ch").agg(low.alias("low"), high.alias("high"))
    # Totals by channel: as many rows as there are channels.
    totals = powers.groupBy("ch").agg(F.avg("low").alias("mean"), F.sum("high").alias("all"))
    wanted = powers.join(F.broadcast(totals), "ch").withColumn("raw", F.col("low") / F.greatest("mean", F.lit(1e-30)))
    kept = wanted.groupBy("ch").agg(F.sum(F.col("raw") * F.col("high")).alias("made"))
    rows = wanted.join(F.broadcast(kept), "ch")
    return rows.select("frame", "ch", F.sqrt(F.col("raw") * F.col("all") / F.greatest("made", F.lit(1e-30))).alias("gain"))


def between_frames(measures: DataFrame) -> DataFrame:
    """(frame, ch, band, energy) with between: geometric mean of the band's energies one frame before and after."""
    order = Window.partitionBy("ch", "band").orderBy("frame")
    return measures.withColumn("between", F.sqrt(F.lag("energy").over(order) * F.lead("energy").over(order)))
