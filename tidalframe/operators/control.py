"""Rate control, resets and selection on ordered rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fold import ordered_scan
from .order import in_stream, so_far

#: Fixed values of the onset rule: filter, averages, ratios, least energy.
HIGH_PASS, FEEDBACK = 0.7548, 0.5095
KEPT, TAKEN, RISE, FALL = 0.7, 0.3, 0.1, 10.0
LEAST_ENERGY = 1_000_000.0 / (32_768.0 * 32_768.0 * 128.0)
#: Fixed values of the rate loop: most doublings of the allowed noise, corrections after them.
DOUBLINGS, CORRECTIONS = 12, 10
#: Fixed values of a section's side information: bits of a choice, bits and reach of a length field.
CHOICE_BITS, LENGTH_BITS, LENGTH_REACH = 4, 5, 31
#: Fixed values of the grant correction: bounds of a valid frame, of the factor, and weights.
PE_NEAR, PE_FIT, FACTOR_BOUNDS, AWAY, BACK = (0.7, 1.5), (0.65, 1.2), (0.85, 1.15), 0.15, 0.30
#: Fixed values of the bandwidth smoothing: targets of modes 1 to 3 (0 and 1 depend on the mode before), weights, bounds.
BANDWIDTHS, NEW_FALL, NEW_RISE, LEAST_WIDTH, MOST_WIDTH = (0.60, 0.75, 0.90, 0.98), 0.75, 0.90625, 0.015625, 0.99609375
#: Fixed values of the least signal-to-noise ratios: PE a bit, share of it, bounds.
PE_A_BIT, PE_SHARE, SNR_BOUNDS = 1.18, 0.024, (0.003, 0.8)


def window_onsets(signal: DataFrame, width: int) -> DataFrame:
    """(stream, frame, attack, place): onsets in frames of four windows of ``width`` samples behind a high-pass.

    A window attacks if a tenth of its energy exceeds the running average of the windows before it; the last
    such window of a frame is its place, -1 without one. Frames whose windows are all faint have none. After an
    attack in a last window, a sharp fall makes an attack at place 0. Incomplete frames are left out.
    """

    def passed(state: tuple, row: tuple) -> tuple:
        y = HIGH_PASS * (row[0] - state[0]) + FEEDBACK * state[1]
        return (row[0], y), (y * y,)

    energies = ordered_scan(signal, "stream", ["t"], ["v"], lambda: (0.0, 0.0), passed, [T.StructField("e", T.DoubleType())])
    frame, window = F.expr(f"t div {4 * width}").alias("frame"), F.expr(f"(t % {4 * width}) div {width}")
    frames = energies.groupBy("stream", frame).agg(F.count("*").alias("n"), *[F.sum(F.when(window == k, F.col("e")).otherwise(0.0)).alias(f"e{k}") for k in range(4)])
    frames = frames.where(F.col("n") == 4 * width)

    def judged(state: tuple, row: tuple) -> tuple:
        level, held, place = state
        hits = []
        for k, energy in enumerate(row):
            level = KEPT * level + TAKEN * (row[k - 1] if k else held)
            if RISE * energy > level:
                hits.append(k)
        now = hits[-1] if hits and max(row) >= LEAST_ENERGY else -1
        if now < 0 and place == 3 and held > FALL * row[1]:
            now = 0
        return (level, row[3], now), (now >= 0, now)

    fields = [T.StructField("attack", T.BooleanType()), T.StructField("place", T.IntegerType())]
    return ordered_scan(frames, "stream", ["frame"], ["e0", "e1", "e2", "e3"], lambda: (0.0, 0.0, -1), judged, fields).select("stream", "frame", "attack", "place")


def curve_gain(level: Column, knots: dict[str, float]) -> Column:
    """A static curve in dB: boost below, nothing in the middle, an early and a full cut above, both ends flat."""
    k = {name: F.lit(v) for name, v in knots.items()}
    early = (k["cut_at"] - k["early_at"]) * k["early_slope"]
    return (
        F.when(level <= k["most_boost_at"], k["most_boost"])
        .when(level < k["boost_at"], (level - k["boost_at"]) * k["boost_slope"])
        .when(level <= k["early_at"], F.lit(0.0))
        .when(level <= k["cut_at"], (level - k["early_at"]) * k["early_slope"])
        .when(level < k["most_cut_at"], (level - k["cut_at"]) * k["cut_slope"] + early)
        .otherwise(-k["most_cut"])
    )


def profile_gains(levels: DataFrame, knots: dict[str, float], weights: dict[str, float], steps: dict[str, float], hold: int) -> DataFrame:
    """(stream, t, gain): the curve's gain of ``levels`` (stream, t, level), smoothed.

    A falling gain follows with the fast or slow attack weight, a rising one with the decay weights, as the level
    moves by more than a step or not. A rising gain waits while the hold count runs, which a gain that still has
    to fall sets to ``hold``.
    """
    curved = levels.withColumn("target", curve_gain(F.col("level"), knots))

    def step(state: tuple, row: tuple) -> tuple:
        smooth, gain, held = state
        level, target = row
        move, falls = level - smooth, target < gain
        fast = move > steps["attack"] if falls else move < -steps["decay"]
        weight = weights[("fast_" if fast else "slow_") + ("attack" if falls else "decay")]
        if falls or not held:
            smooth, gain = smooth + weight * move, gain + weight * (target - gain)
        held = hold if target < gain else max(0, held - 1)
        return (smooth, gain, held), (gain,)

    return ordered_scan(curved, "stream", ["t"], ["level", "target"], lambda: (0.0, 0.0, 0), step, [T.StructField("gain", T.DoubleType())]).select("stream", "t", "gain")


def code_bits(v: Column, step: Column) -> Column:
    """Bits of ``v`` in whole ``steps``: one for 0, else twice the number's binary digits and one more."""
    q = F.floor(F.abs(v) / step + 0.5).cast("long")
    return F.when(q == 0, 1).otherwise(2 * F.length(F.bin(q)) + 1).cast("long")


def rate_loops(lines: DataFrame, keys: list[str], target: int) -> DataFrame:
    """(keys, doublings, bits): how often the noise of ``lines`` (keys, v, allowed) is doubled until they fit ``target`` bits, at most DOUBLINGS times.

    All 13 candidates are sums of one aggregation, so nothing is multiplied or read twice.
    """
    sums = [F.sum(code_bits(F.col("v"), F.sqrt(F.col("allowed") * float(2**k)))).alias(f"b{k}") for k in range(DOUBLINGS + 1)]
    tried = lines.groupBy(*keys).agg(*sums)
    first = F.coalesce(*[F.when(F.col(f"b{k}") <= target, F.lit(k)) for k in range(DOUBLINGS)], F.lit(DOUBLINGS))
    return tried.select(*keys, first.alias("doublings"), F.element_at(F.array(*[f"b{k}" for k in range(DOUBLINGS + 1)]), first + 1).alias("bits"))


def rate_fits(lines: DataFrame, keys: list[str], target: int) -> DataFrame:
    """(keys, relaxation, bits): the noise factor of ``rate_loops``, then halved down between the last two candidates.

    ``lines`` of a key are few (a frame), so they travel as one array; the corrections are a fold in the JVM.
    """
    looped = rate_loops(lines, keys, target)
    held = lines.groupBy(*keys).agg(F.collect_list(F.struct("v", "allowed")).alias("x")).join(looped, keys)

    def bits(x: Column, factor: Column) -> Column:
        return F.aggregate(x, F.lit(0).cast("long"), lambda a, z: a + code_bits(z["v"], F.sqrt(z["allowed"] * factor)))

    def corrected(s: Column, _: Column) -> Column:
        middle = (s["low"] + s["high"]) * 0.5
        fits = bits(F.col("x"), middle) <= target
        return F.struct(F.when(fits, s["low"]).otherwise(middle).alias("low"), F.when(fits, middle).otherwise(s["high"]).alias("high"))

    high = F.pow(F.lit(2.0), F.col("doublings"))
    start = F.struct((high / 2).alias("low"), high.alias("high"))
    final = F.aggregate(F.sequence(F.lit(1), F.lit(CORRECTIONS)), start, corrected)["high"]
    factor = F.when((F.col("doublings") > 0) & (F.col("bits") <= target), final).otherwise(high)
    rows = held.withColumn("relaxation", factor)
    return rows.select(*keys, "relaxation", bits(F.col("x"), F.col("relaxation")).alias("bits"))


def chosen_sections(costs: DataFrame, key: str, choices: int) -> DataFrame:
    """(key, start, stop, choice, bits): the cheapest cover of each key's positions by sections of one choice.

    ``costs`` is (key, x) with x an array of arrays of ``choices`` costs, null where a choice can't code the
    position; a section costs its positions and its side information. Of equal ways the one with the earliest
    start of its last section, then the least choice, is taken. Keys of equal length are solved together.
    """

    def side(n: int) -> int:
        return CHOICE_BITS + LENGTH_BITS * (n // LENGTH_REACH + 1)

    def solved(x: np.ndarray) -> list[list[tuple[int, int, int, float]]]:
        rows, n, _ = x.shape
        run = np.concatenate([np.zeros((rows, 1, choices)), np.cumsum(x, axis=1)], axis=1)
        best, back = np.zeros((rows, n + 1)), np.zeros((rows, n + 1), int)
        for stop in range(1, n + 1):
            extra = np.array([side(stop - start) for start in range(stop)])
            ways = best[:, :stop, None] + (run[:, stop, None, :] - run[:, :stop, :]) + extra[None, :, None]
            flat = ways.reshape(rows, -1)
            back[:, stop] = flat.argmin(axis=1)
            best[:, stop] = flat.min(axis=1)
        out = []
        for r in range(rows):
            parts, stop = [], n
            while stop:
                start, choice = divmod(int(back[r, stop]), choices)
                parts.append((start, stop, choice, int(run[r, stop, choice] - run[r, start, choice]) + side(stop - start)))
                stop = start
            out.append(parts[::-1])
        return out

    @F.pandas_udf("array<struct<start: int, stop: int, choice: int, bits: long>>")
    def sections(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out: list = [None] * len(batch)
            sizes = np.array([len(v) for v in batch], int)
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                x = np.array([[[1e12 if c is None or c != c else c for c in p] for p in batch.iloc[i]] for i in at], float).reshape(len(at), n, choices)
                for i, parts in zip(at, solved(x), strict=True):
                    out[i] = [{"start": a, "stop": b, "choice": c, "bits": w} for a, b, c, w in parts]
            yield pd.Series(out)

    return costs.select(key, F.inline(sections("x")))


def corrected_grants(rows: DataFrame) -> DataFrame:
    """(unit, sub, factor, grant): ``rows`` (unit, sub, demand, granted, spent) with the grant times a factor that follows how far spent bits miss it.

    ``spent`` is what the row before has used, in demand units; without it, or when the demand jumps, the factor is 1.
    """
    low, high = FACTOR_BOUNDS

    def step(state: tuple, row: tuple) -> tuple:
        factor, last = state
        demand, granted, spent = row
        steady = spent is not None and spent > 0 and PE_NEAR[0] * last < demand < PE_NEAR[1] * last and PE_FIT[0] * spent < last < PE_FIT[1] * spent
        if not steady:
            factor = 1.0
        else:
            ratio = last / spent
            wanted = min(max(min(1.1 * ratio, 1.0), low), 1.0) if last <= spent else max(min(0.9 * ratio, high), 1.0)
            if (wanted - 1.0) * (factor - 1.0) < 0:
                factor = 1.0
            weight = AWAY if (factor < 1.0 and wanted < factor) or (factor > 1.0 and wanted > factor) else BACK
            factor = min(max((1.0 - weight) * factor + weight * wanted, low), high)
        return (factor, granted), (factor, granted * factor)

    fields = [T.StructField("factor", T.DoubleType()), T.StructField("grant", T.DoubleType())]
    return ordered_scan(rows, "unit", ["sub"], ["demand", "granted", "spent"], lambda: (1.0, 0.0), step, fields).select("unit", "sub", "factor", "grant")


def smoothed_bandwidths(modes: DataFrame) -> DataFrame:
    """(stream, t, bandwidth): ``modes`` (stream, t, mode 0 to 3) as filter widths, falling and rising by different weights.

    The modes before are known, so targets are a window; the smoothing is a recurrence.
    """
    before = F.lag("mode", 1, 0).over(in_stream())
    weak, fair, strong, most = (F.lit(b) for b in BANDWIDTHS)
    target = F.when(F.col("mode") == 1, F.when(before == 0, weak).otherwise(fair)).when(F.col("mode") == 2, strong).when(F.col("mode") == 3, most).otherwise(F.when(before == 1, weak).otherwise(0.0))

    def step(old: float, row: tuple) -> tuple:
        share = NEW_FALL if row[0] < old else NEW_RISE
        value = share * row[0] + (1.0 - share) * old
        value = 0.0 if value < LEAST_WIDTH else min(value, MOST_WIDTH)
        return value, (value,)

    out = ordered_scan(modes.withColumn("target", target), "stream", ["t"], ["target"], lambda: 0.0, step, [T.StructField("bandwidth", T.DoubleType())])
    return out.select("stream", "t", "bandwidth")


def since_reset(rows: DataFrame, sums: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``rows`` (stream, t) with a running sum for each name of ``sums``: (value, reset), from the last row where reset holds on, that row left out."""
    for name, (value, reset) in sums.items():
        rows = rows.withColumn("__e", F.sum(reset.cast("int")).over(so_far()))
        inside = Window.partitionBy("stream", "__e").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn(name, F.sum(F.when(reset, 0).otherwise(value)).over(inside).cast("long")).drop("__e")
    return rows


def flagged_output(rows: DataFrame, fade: float, most: int) -> DataFrame:
    """(stream, t, out): ``rows`` (stream, t, v, flag) as a player that obeys flags gives them.

    ``conceal`` and bad rows (null v) repeat the last good value since the last ``interrupt``, fading with each
    row since, for ``most`` rows; without one they are silent. ``flush`` gives the value still held from the row
    before, ``interrupt`` and ``clear`` rows play their own value but forget what was before.
    """
    forgets = F.coalesce(F.col("flag").isin("interrupt", "clear"), F.lit(False))
    epochs = rows.withColumn("__e", F.sum(forgets.cast("int")).over(so_far()))
    order = Window.partitionBy("stream", "__e").orderBy("t")
    past = order.rowsBetween(Window.unboundedPreceding, 0)
    plain = F.col("v").isNotNull() & ~F.col("flag").eqNullSafe("conceal") & ~F.col("flag").eqNullSafe("flush")
    good = F.last(F.when(plain, F.struct("v", "t")), ignorenulls=True).over(past)
    held = F.lag("v", 1, 0.0).over(order)
    k = F.col("t") - F.col("good.t")
    faded = F.when(k <= most, F.col("good.v") * F.pow(F.lit(fade), k)).otherwise(0.0)
    out = F.when(plain, F.col("v")).when(F.col("flag").eqNullSafe("flush"), F.coalesce("held", F.lit(0.0))).otherwise(F.coalesce(faded, F.lit(0.0)))
    return epochs.withColumns({"good": good, "held": held}).select("stream", "t", out.alias("out"))


def delay_replaced(signal: DataFrame, n: int, replace: Column, value: Column) -> DataFrame:
    """(stream, t, delayed): ``signal`` ``n`` rows late; where ``replace`` holds, what is still in the line becomes ``value`` of its own row.

    The rows in the line at a replacement at row s are s - n to s - 1: those leave at s to s + n - 1.
    """
    order = in_stream()
    last = F.last(F.when(replace, F.col("t")), ignorenulls=True).over(so_far())
    rows = signal.withColumns({"__s": last, "__v": F.lag("v", n, 0.0).over(order), "__r": F.lag(value, n, 0.0).over(order)})
    return rows.select("stream", "t", F.when(F.col("t") - F.col("__s") < n, F.col("__r")).otherwise(F.col("__v")).alias("delayed"))


def noise_pairs(frames: DataFrame, width: int, generator: tuple[int, int]) -> DataFrame:
    """``frames`` (..., seed, left, right, shared: arrays of booleans by band) with x and y: noise of unit energy in the noisy bands of two channels.

    One generator serves a frame: band by band, the left channel draws first; where both are noisy and the band is
    shared, both get one draw. Bands without noise stay 0. All frames of a batch draw together.
    """
    a, c = (np.uint64(g) for g in generator)
    low = np.uint64(0xFFFFFFFF)

    @F.pandas_udf("struct<x: array<double>, y: array<double>>")
    def drawn(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for seed, left, right, shared in batches:
            if not len(seed):
                yield pd.DataFrame({"x": [], "y": []})
                continue
            state = seed.to_numpy().astype(np.uint64) & low
            flags = [np.stack(s.to_numpy()).astype(bool) for s in (left, right, shared)]
            out = np.zeros((2, len(state), flags[0].shape[1], width))

            def draw(who: np.ndarray, state: np.ndarray) -> np.ndarray:
                made = np.zeros((len(state), width))
                for i in range(width):
                    state[who] = (state[who] * a + c) & low
                    made[who, i] = state[who].astype(np.uint32).view(np.int32)
                made[who] /= np.sqrt((made[who] ** 2).sum(axis=1, keepdims=True))
                return made

            for band in range(flags[0].shape[1]):
                noisy, other, one = (f[:, band] for f in flags)
                first = draw(noisy, state)
                both = noisy & other & one
                second = draw(other & ~both, state)
                second[both] = first[both]
                out[0, :, band], out[1, :, band] = first, second
            flat = out.reshape(2, len(state), -1)
            yield pd.DataFrame({"x": list(flat[0]), "y": list(flat[1])})

    made = frames.withColumn("__n", drawn("seed", "left", "right", "shared"))
    return made.withColumns({"x": F.col("__n.x"), "y": F.col("__n.y")}).drop("__n")


def bark(line: Column, lines: int, rate: int) -> Column:
    """The critical-band number of a line's frequency."""
    f = line * float(rate) / (2.0 * lines)
    slow = F.atan(f * (4.0 / 3.0) * 0.0001)
    return 13.3 * F.atan(f * 0.00076) + 3.5 * slow * slow


def least_snr(bands: DataFrame, lines: int, rate: int, top: int) -> DataFrame:
    """``bands`` (start, stop, bitrate) with snr: the least ratio a band is granted, from its share of the critical bands up to ``top``."""
    share = F.greatest(F.least(bark(F.lit(top), lines, rate), F.lit(24.0)) / 25.0, F.lit(2.2250738585072014e-308))
    window = F.col("bitrate") / F.lit(float(rate)) * PE_A_BIT * PE_SHARE * lines
    wide = bark(F.col("stop"), lines, rate) - bark(F.col("start"), lines, rate)
    a_line = window / share * wide / F.greatest(F.col("stop") - F.col("start"), F.lit(1))
    ratio = 1.0 / F.greatest(F.pow(F.lit(2.0), a_line) - 1.5, F.lit(1.0))
    return bands.withColumn("snr", F.greatest(F.lit(SNR_BOUNDS[0]), F.least(F.lit(SNR_BOUNDS[1]), ratio)))
