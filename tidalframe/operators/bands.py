"""Banded measures of spectra (frame, ch, line, v): one pass, one shuffle by (frame, ch)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keeps logarithms and quotients finite.
FLOOR = 1e-30
#: Shares of a band's energy that spread to the next and the previous band.
SPREAD_UP, SPREAD_DOWN = 0.15, 0.05
#: Fixed values of the masking: the share of the spread energy that hides, what tonality takes off it, the least threshold of a line, its rise by band.
HIDING, TONAL, LEAST, RISE = 0.16, 0.13, 1e-9, 0.08


def band_measures(banded: DataFrame) -> DataFrame:
    """(frame, ch, band, width, energy, tonality, form_factor) of a spectrum that knows its bands.

    Tonality is one minus the spectral flatness, geometric over arithmetic mean of the powers.
    """
    power = F.col("v") * F.col("v") + F.lit(FLOOR)
    flat = F.exp(F.avg(F.log(power))) / F.greatest(F.avg(power), F.lit(FLOOR))
    return banded.groupBy("frame", "ch", "band").agg(
        F.count("*").alias("width"),
        F.sum(power).alias("energy"),
        (1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), flat))).alias("tonality"),
        F.sum(F.sqrt(F.abs("v"))).alias("form_factor"),
    )


def masking(measures: DataFrame) -> DataFrame:
    """``measures`` with threshold: what the neighbours' spread energy hides, at most the band's own."""
    order = Window.partitionBy("frame", "ch").orderBy("band")
    spread = F.col("energy") + F.coalesce(F.lag("energy").over(order), F.lit(0.0)) * SPREAD_UP + F.coalesce(F.lead("energy").over(order), F.lit(0.0)) * SPREAD_DOWN
    least = F.col("width") * LEAST * F.pow(1 + F.col("band") * RISE, F.lit(2.0))
    hidden = F.greatest(spread * (HIDING - TONAL * F.col("tonality")), least)
    return measures.withColumn("threshold", F.least(hidden, F.greatest(F.col("energy"), least)))


def perceptual_entropy(masked: DataFrame) -> DataFrame:
    """(frame, ch, entropy): bits that the energies over their thresholds ask for."""
    bits = F.when(F.col("energy") > F.col("threshold"), F.col("width") * F.log2(F.col("energy") / F.col("threshold"))).otherwise(0.0)
    return masked.groupBy("frame", "ch").agg(F.sum(bits).alias("entropy"))


def chunk_energies(spectrum: DataFrame, size: int = 8) -> DataFrame:
    """(frame, ch, chunk, energy) of each ``size`` consecutive lines."""
    return spectrum.groupBy("frame", "ch", F.expr(f"line div {size}").alias("chunk")).agg(F.sum(F.col("v") * F.col("v")).alias("energy"))


def transient_ratio(chunks: DataFrame) -> DataFrame:
    """(frame, ch, ratio): largest over mean chunk energy; 0 in silence."""
    mean = F.avg("energy")
    return chunks.groupBy("frame", "ch").agg(F.when(mean <= 1.1920929e-07, 0.0).otherwise(F.max("energy") / mean).alias("ratio"))


def similar_runs(chunks: DataFrame) -> DataFrame:
    """(frame, ch, grp, first, length): runs of chunks whose neighbours differ fourfold at most."""
    order = Window.partitionBy("frame", "ch").orderBy("chunk")
    before = F.lag("energy").over(order)
    low, high = F.least(before, F.col("energy")), F.greatest(before, F.col("energy"))
    new = F.when(before.isNull(), 0).when((high <= 1e-20) | (high / F.greatest(low, F.lit(1e-20)) <= 4.0), 0).otherwise(1)
    marked = chunks.withColumn("new", new).withColumn("grp", F.sum("new").over(order))
    return marked.groupBy("frame", "ch", "grp").agg(F.min("chunk").alias("first"), F.count("*").alias("length"))


def grouping_lengths(flags: DataFrame, key: str, bits: Column) -> DataFrame:
    """(key, lengths): runs of eight windows from seven bits, high first; a set bit joins its predecessor."""
    windows = flags.select(F.col(key), bits.alias("b")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(7))))
    joins = F.when(F.col("i") == 0, 0).otherwise(F.call_function("shiftright", F.col("b").cast("int"), 7 - F.col("i")).bitwiseAND(F.lit(1)))
    order = Window.partitionBy(key).orderBy("i")
    grouped = windows.withColumn("g", F.sum(F.when(F.col("i") == 0, 0).otherwise(1 - joins)).over(order))
    runs = grouped.groupBy(key, "g").agg(F.count("*").alias("n"))
    return runs.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "n"))), lambda x: x["n"].cast("string")), ",").alias("lengths"))


def band_gains(measures: DataFrame, targets: Column, most: float = 1e4) -> DataFrame:
    """``measures`` with gain: root of target over mean power, at most ``most``."""
    mean = F.col("energy") / F.col("width")
    return measures.withColumn("gain", F.least(F.sqrt(targets / F.greatest(mean, F.lit(FLOOR))), F.lit(most)))


def peaks_deemphasis(spectrum: DataFrame, lines: int, size: int = 8) -> DataFrame:
    """(frame, ch, chunk, gain) of the lowest quarter: running maximum, from 0.1 on, of root energy over peak."""
    chunks = spectrum.where(F.col("line") < lines // 4).groupBy("frame", "ch", F.expr(f"line div {size}").alias("chunk"))
    energy = chunks.agg(F.sum(F.col("v") * F.col("v")).alias("energy"))
    peak = F.max("energy").over(Window.partitionBy("frame", "ch"))
    run = F.max(F.sqrt(F.col("energy") / F.greatest(peak, F.lit(FLOOR)))).over(Window.partitionBy("frame", "ch").orderBy("chunk"))
    return energy.select("frame", "ch", "chunk", F.greatest(F.lit(0.1), run).alias("gain"))
