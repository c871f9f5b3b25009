"""Operators on ordered rows: differences, running sums, delays, peaks, gaps, budgets.

Signals are (stream, t, v). A window sorts each stream once; nothing is collected into arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fold import ordered_scan


def in_stream() -> WindowSpec:
    return Window.partitionBy("stream").orderBy("t")


def so_far() -> WindowSpec:
    return in_stream().rowsBetween(Window.unboundedPreceding, 0)


def delta_decoded(rows: DataFrame, gain: int) -> DataFrame:
    """``rows`` (stream, t, kind, word) with value: two running sums by kind, from ``gain`` and from 0.

    Spectral and intensity words add up, each by itself; noise words don't; other kinds give 0. Words
    are relative to 60 and values to 100.
    """
    word = F.col("word") - 60
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, word).otherwise(0)).over(so_far())
    value = F.when(F.col("kind") == "spectral", of("spectral") + gain - 100).when(F.col("kind") == "intensity", of("intensity") - 100).when(F.col("kind") == "noise", word + gain - 100).otherwise(0)
    return rows.withColumn("value", value.cast("long"))


def running_total(rows: DataFrame, start: int) -> DataFrame:
    """``rows`` (stream, t, word) with value: ``start`` plus all words after the first, which is implied."""
    return rows.withColumn("value", (F.sum(F.when(F.col("t") == 0, 0).otherwise(F.col("word"))).over(so_far()) + start).cast("long"))


def run_lengths(rows: DataFrame) -> DataFrame:
    """(stream, pos, code): each (stream, t, code, n) repeated ``n`` times at running positions."""
    start = F.coalesce(F.sum("n").over(in_stream().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("start", start).where("n > 0")
    return placed.select("stream", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("pos"), "code")


def delayed(signal: DataFrame, n: int, epoch: Column | None = None) -> DataFrame:
    """``signal`` with delayed: the value ``n`` rows before, 0 before the start of the stream or its epoch."""
    by = Window.partitionBy("stream", epoch).orderBy("t") if epoch is not None else in_stream()
    return signal.withColumn("delayed", F.lag("v", n, 0.0).over(by))


def running_peak(signal: DataFrame, attack: int) -> DataFrame:
    """``signal`` with peak: the largest of 1 and |v| over this row and the ``attack`` before."""
    return signal.withColumn("peak", F.greatest(F.lit(1.0), F.max(F.abs("v")).over(in_stream().rowsBetween(-attack, 0))))


#: Fixed value: the share of the way to a lower gain that the look-ahead has to cover.
REACH = 0.9


def limited(signal: DataFrame, attack: int, release: int) -> DataFrame:
    """(stream, t, gain, limited): a look-ahead limiter to 1, ``attack`` rows late.

    The peak ahead is a window. The gain moves towards an aim, of which a tenth is left after ``attack`` + 1 rows
    down or ``release`` + 1 rows up. The aim is the peak's reciprocal; while the gain has to fall it lies so far beyond
    that nine tenths of the way to it are enough, and the lowest such aim is kept. The gain never falls under the reciprocal.
    """
    left = {False: 0.1 ** (1.0 / (release + 1)), True: 0.1 ** (1.0 / (attack + 1))}
    ready = delayed(running_peak(signal, attack), attack).withColumn("bound", 1.0 / F.col("peak"))

    def step(state: tuple, row: tuple) -> tuple:
        aim, gain = state
        bound, late = row
        beyond = gain + (bound - gain) / REACH
        aim = min(aim, beyond) if bound < gain else bound
        falls = aim < gain
        gain = aim + left[falls] * (gain - aim)
        gain = max(gain, bound) if falls else gain
        return (aim, gain), (gain, min(max(late * gain, -1.0), 1.0))

    fields = [T.StructField("gain", T.DoubleType()), T.StructField("limited", T.DoubleType())]
    out = ordered_scan(ready, "stream", ["t"], ["bound", "delayed"], lambda: (1.0, 1.0), step, fields)
    return out.select("stream", "t", "gain", "limited")


def block_states(ratios: DataFrame, threshold: float) -> DataFrame:
    """(stream, t, state): long, start, short or stop, driven by ``ratio`` >= ``threshold``."""

    def step(state: str, row: tuple) -> tuple:
        attack = row[0] >= threshold
        if state == "start":
            state = "short"
        elif state == "short":
            state = "short" if attack else "stop"
        else:
            state = "start" if attack else "long"
        return state, (state,)

    out = ordered_scan(ratios, "stream", ["t"], ["ratio"], lambda: "long", step, [T.StructField("state", T.StringType())])
    return out.select("stream", "t", "state")


#: The shares of the old and the new energy in the average.
OLD, NEW = 0.7, 0.3


def onsets(signal: DataFrame, factor: float) -> DataFrame:
    """(stream, t, level, onset): energy over ``factor`` times its exponential average, 0.7 old and 0.3 new."""

    def step(state: float, row: tuple) -> tuple:
        energy = row[0] * row[0]
        hit = energy > factor * state
        return OLD * state + NEW * energy, (state, hit)

    fields = [T.StructField("level", T.DoubleType()), T.StructField("onset", T.BooleanType())]
    return ordered_scan(signal, "stream", ["t"], ["v"], lambda: 0.0, step, fields).select("stream", "t", "level", "onset")


def concealed(signal: DataFrame, fade: float, most: int) -> DataFrame:
    """(stream, t, v, lost): ``signal`` (stream, t, v or null) with nulls replaced by the last good value, fading.

    The k-th lost row in a row gets it times ``fade``^k, and 0 from the one after ``most`` on; before
    any good row it is 0.
    """
    good = F.last("v", ignorenulls=True).over(so_far())
    at = F.last(F.when(F.col("v").isNotNull(), F.col("t")), ignorenulls=True).over(so_far())
    k = F.col("t") - F.coalesce(F.col("at"), F.lit(-1))
    rows = signal.withColumns({"good": good, "at": at})
    filled = F.when(k > most, 0.0).otherwise(F.coalesce("good", F.lit(0.0)) * F.pow(F.lit(fade), k))
    return rows.select("stream", "t", F.coalesce("v", filled).alias("v"), F.col("v").isNull().alias("lost"))


def recovered(signal: DataFrame, fade: float, most: int) -> DataFrame:
    """(stream, t, factor): where the fade-in of each good row after losses starts; 1 without losses."""
    lost = F.when(F.col("v").isNull(), 1).otherwise(0)
    at = F.last(F.when(F.col("v").isNotNull(), F.col("t")), ignorenulls=True).over(in_stream().rowsBetween(Window.unboundedPreceding, -1))
    rows = signal.withColumns({"lost": lost, "gap": F.col("t") - F.coalesce(at, F.lit(-1)) - 1}).where("v is not null")
    return rows.select("stream", "t", F.when(F.col("gap") == 0, 1.0).otherwise(F.pow(F.lit(fade), F.least(F.col("gap"), F.lit(most)))).alias("factor"))


def reservoir(units: DataFrame, nominal: int, capacity: int, start: int = 0) -> DataFrame:
    """``units`` (unit, sub, bits) with fullness after each: min(capacity, fullness + nominal - bits).

    In closed form over running sums: what the cap has cut off so far is the running maximum of the
    excess.
    """
    order = Window.partitionBy("unit").orderBy("sub").rowsBetween(Window.unboundedPreceding, 0)
    rows = units.withColumn("__s", F.sum(F.lit(nominal) - F.col("bits")).over(order) + start)
    over = F.greatest(F.lit(0), F.max(F.col("__s") - capacity).over(order))
    return rows.withColumn("fullness", (F.col("__s") - over).cast("long")).drop("__s")


def granted(filled: DataFrame, nominal: int, start: int = 0) -> DataFrame:
    """``filled`` with granted: the bits wanted, at most the nominal ones and what the reservoir held before."""
    before = F.lag("fullness", 1, start).over(Window.partitionBy("unit").orderBy("sub"))
    return filled.withColumn("granted", F.least(F.col("bits"), nominal + before).cast("long"))


def losses(rows: DataFrame, rate: int, bitrate: int, samples: int) -> DataFrame:
    """``rows`` (distance, bits) with lost: units that fit the distance in bits, halves down, without the one found."""
    d = bitrate * samples
    n = F.lit(rate).cast("long") * (F.col("distance") + F.col("bits"))
    whole, rest = F.expr(f"({rate}L * (distance + bits)) div {d}L"), n % d
    units = whole - F.when(d - rest >= rest, 1).otherwise(0)
    return rows.withColumn("lost", F.when(n <= 0, 0).otherwise(F.greatest(units, F.lit(0))).cast("long"))


def epochs(rows: DataFrame, config: str) -> DataFrame:
    """``rows`` with epoch: how often ``config`` has changed so far in the stream."""
    before = F.lag(config).over(in_stream())
    changed = F.when(before.isNull() | before.eqNullSafe(F.col(config)), 0).otherwise(1)
    return rows.withColumn("__c", changed).withColumn("epoch", F.sum("__c").over(so_far()).cast("long")).drop("__c")


def carried(rows: DataFrame, value: str, set_when: Column, seconds: int) -> DataFrame:
    """``rows`` with carried: the last value set, while it is at most ``seconds`` old."""
    known = F.last(F.when(set_when, F.struct(F.col(value).alias("v"), "ts")), ignorenulls=True).over(so_far())
    age = F.timestamp_diff("MICROSECOND", known["ts"], F.col("ts"))
    return rows.withColumn("carried", F.when(age <= seconds * 1_000_000, known["v"]))


def overlap_added(frames: DataFrame) -> DataFrame:
    """(ch, frame, line, v): (ch, frame, x) with x of two halves: the first plus the frame before's second.

    After the last frame one more row of lines gives the second half that is still held.
    """
    order = Window.partitionBy("ch").orderBy("frame")
    half = F.expr("size(x) div 2").cast("int")
    last = frames.groupBy("ch").agg(F.max("frame").alias("frame")).select("ch", (F.col("frame") + 1).alias("frame"), F.lit(None).cast("array<double>").alias("x"))
    rows = frames.select("ch", "frame", "x").unionByName(last)
    second = F.lag(F.slice("x", half + 1, half)).over(order)
    rows = rows.withColumns({"first": F.slice("x", F.lit(1), half), "held": second})
    return rows.select("ch", "frame", F.posexplode(F.zip_with(F.coalesce("first", F.transform("held", lambda _: F.lit(0.0))), F.coalesce("held", F.transform("first", lambda _: F.lit(0.0))), lambda a, b: a + b)).alias("line", "v"))


def carried_losses(rows: DataFrame, rate: int, bitrate: int, samples: int) -> DataFrame:
    """``rows`` (unit, sub, distance) with lost: whole units in the distance, the rest carried to the next row.

    With a remainder that is carried, the units found so far are the floor of the running sum.
    """
    d = bitrate * samples
    order = Window.partitionBy("unit").orderBy("sub")
    total = rows.withColumn("__s", F.sum(F.col("distance") * rate).over(order))
    so_far = F.expr(f"__s div {d}L")
    return total.withColumn("__u", so_far).withColumn("lost", (F.col("__u") - F.lag("__u", 1, 0).over(order)).cast("long")).drop("__s", "__u")


def pulsed(levels: DataFrame, offsets: list[int], amplitudes: list[int]) -> DataFrame:
    """``levels`` (frame, ch, line, first, q) with pulses at running offsets from ``first``: added where q > 0, else subtracted."""
    at, out = 0, F.col("q")
    for offset, amplitude in zip(offsets, amplitudes, strict=True):
        at += offset
        out = F.when(F.col("line") == F.col("first") + at, out + F.when(out > 0, amplitude).otherwise(-amplitude)).otherwise(out)
    return levels.withColumn("q", out)
