"""Codes, deltas, segments and predictors: integer and polynomial rules of coded streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the escape code: its mark, first and last width, what a too long one becomes.
ESCAPE, FIRST_WIDTH, LAST_WIDTH, TOO_LONG = 16, 4, 13, 8192
#: Fixed values of the step noise: its generator, the bit that gives the sign, lines of a chunk, a level's unit.
STEP_GENERATOR, SIGN_BIT, CHUNK, UNIT = (69069, 5), 0x10000, 8, 0.0625
#: Fixed value of the noise shaping: the weight by which a predictor's taps shrink.
SHRINK = 0.92
#: Fixed values of the whitening: least determinant, and the tap energy from which on a predictor is refused.
SINGULAR, UNSTABLE = 1e-20, 16.0
#: By index the channels, single, paired and low elements of a layout.
LAYOUTS = (
    (0, 0, 0, 0), (1, 1, 0, 0), (2, 0, 1, 0), (3, 1, 1, 0), (4, 2, 1, 0), (5, 1, 2, 0), (6, 1, 2, 1),
    (8, 1, 3, 1), (2, 2, 0, 0), (3, 1, 1, 0), (4, 0, 2, 0), (7, 2, 2, 1), (8, 1, 3, 1), (24, 6, 8, 2),
)


def escaped(level: Column, bits: Column, width: int) -> Column:
    """What ``level`` stands for: itself, or, if it is the mark, the number that ``width`` ``bits`` spell.

    As many ones as the number has bits beyond four, a zero, then the bits after the first one.
    """
    text = F.lpad(F.bin(bits), width, "0")
    ones = F.length(F.regexp_extract(text, "^1*", 0))
    n = F.least(ones, F.lit(LAST_WIDTH - FIRST_WIDTH)) + FIRST_WIDTH
    rest = F.conv(F.substring(text, ones + 2, n), 2, 10).cast("int")
    size = F.when(n == LAST_WIDTH, TOO_LONG).otherwise(F.call_function("shiftleft", F.lit(1), n) + rest)
    sign = F.when((level < 0) & (n < LAST_WIDTH), -1).otherwise(1)
    return F.when(F.abs(level) == ESCAPE, sign * size).otherwise(level).cast("int")


def reversed_bits(value: Column, n: int) -> Column:
    """The lowest ``n`` bits, up to 62, in the other order."""
    return F.conv(F.reverse(F.right(F.lpad(F.bin(value), 64, "0"), F.lit(n))), 2, 10).cast("long")


def side_data(data: Column) -> Column:
    """(mode, value) of a side-data block of bytes, null unless it has a compression value and is well-formed.

    Fixed values: a mark, two set bits and a clear one around the mode, a status byte that names what follows.
    """
    byte = lambda i: F.conv(F.hex(F.substring(data, i + 1, F.lit(1))), 16, 10).cast("int")
    info, status = byte(F.lit(1)), byte(F.lit(2))
    at = F.lit(3) + F.shiftright(status, 4).bitwiseAND(F.lit(1))
    good = (byte(F.lit(0)) == 0xBC) & (F.shiftright(info, 6) == 3) & (info % 2 == 0) & (status < 32) & (status.bitwiseAND(F.lit(4)) != 0) & (F.length(data) >= at + 2) & (byte(at) == 1)
    return F.when(good, F.struct(F.shiftright(info, 2).bitwiseAND(F.lit(3)).alias("mode"), byte(at + 1).alias("value")))


def layout_matches(elements: DataFrame, key: str) -> DataFrame:
    """``elements`` (key, index, kind: single, pair or low) by key: channels, and whether they make the layout of their index."""
    count = lambda kind: F.count_if(F.col("kind") == kind)
    rows = elements.groupBy(key, "index").agg(count("single").alias("s"), count("pair").alias("p"), count("low").alias("l"))
    wanted = F.lit(False)
    for i, (channels, single, pair, low) in enumerate(LAYOUTS[1:], 1):
        wanted = wanted | ((F.col("index") == i) & (F.col("s") + 2 * F.col("p") + F.col("l") == channels) & (F.col("s") == single) & (F.col("p") == pair) & (F.col("l") == low))
    return rows.select(key, "index", (F.col("s") + 2 * F.col("p") + F.col("l")).alias("channels"), wanted.alias("matches"))


def reconstructed(deltas: DataFrame, by: list[str], row: str, place: str) -> DataFrame:
    """``deltas`` (by, row, place, delta, in_time) with value: rows coded along their places or against the row before.

    In closed form: the running sum along the last row coded along its places, and at each place the sum of the
    deltas in time since. Before the first row all values are 0.
    """
    along = Window.partitionBy(*by, row).orderBy(place)
    across = Window.partitionBy(*by, place).orderBy(row)
    rows = deltas.withColumn("__c", F.sum("delta").over(along)).withColumn("__e", F.sum((~F.col("in_time")).cast("int")).over(across))
    start = F.when(~F.col("in_time"), F.col("__c")).otherwise(F.col("delta"))
    return rows.withColumn("value", F.sum(start).over(Window.partitionBy(*by, place, "__e").orderBy(row))).drop("__c", "__e")


def segments(sections: DataFrame, by: str, budget: Column) -> DataFrame:
    """(by, section, word, first, last): the bits that each code word gets, the most urgent sections first.

    ``sections`` is (by, section, priority, words, width); sections without priority get none. Words that no longer
    fit the ``budget`` get none either, and the last one that does takes what is left.
    """
    words = sections.where((F.col("priority") > 0) & (F.col("width") > 0)).withColumn("budget", budget)
    words = words.select(by, "section", "priority", "width", "budget", F.explode(F.sequence(F.lit(0), F.col("words") - 1)).alias("word"))
    order = Window.partitionBy(by).orderBy(F.col("priority").desc(), "section", "word")
    placed = words.withColumn("stop", F.sum("width").over(order)).where(F.col("stop") <= F.col("budget"))
    is_last = F.lead("stop").over(order).isNull()
    return placed.select(by, "section", "word", (F.col("stop") - F.col("width")).alias("first"), (F.when(is_last, F.col("budget")).otherwise(F.col("stop")) - 1).alias("last"))


def book_costs(levels: DataFrame, by: list[str], books: list[tuple[int, int]], bits: Column) -> DataFrame:
    """(by, c0, c1, ...): what each book of ``books`` (dimension, largest level) costs for the ``levels`` (by, q), null where it can't code them.

    A book codes a group whose size its dimension divides and whose levels it reaches; book 0 costs nothing and
    codes only zeros.
    """
    most, n, total = F.max(F.abs("q")), F.count("*"), F.sum(bits)
    rows = levels.groupBy(*by).agg(most.alias("most"), n.alias("n"), total.alias("total"))
    costs = [F.when(F.col("most") == 0, F.lit(0).cast("long")).alias("c0")]
    costs += [F.when((F.col("n") % d == 0) & (F.col("most") <= top), F.col("total") + F.expr(f"n div {d}") * i).alias(f"c{i}") for i, (d, top) in enumerate(books, 1)]
    return rows.select(*by, *costs)


def step_noise(x: Column, factor: Column, seed: Column) -> Column:
    """``x`` with noise of one size and random sign in the chunks of eight lines that are silent, from the sixth part on.

    One generator runs through a row's silent chunks; all rows of a batch move together.
    """
    a, c = (np.uint64(g) for g in STEP_GENERATOR)

    @F.pandas_udf("array<double>")
    def filled(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for lines, factors, seeds in batches:
            if not len(lines):
                yield pd.Series([], dtype=object)
                continue
            rows = np.stack(lines.to_numpy()).astype(float)
            level = UNIT * (8 - np.minimum(factors.to_numpy(), 7))
            state = seeds.to_numpy().astype(np.uint64) & np.uint64(0xFFFFFFFF)
            for at in range(rows.shape[1] // 6, rows.shape[1], CHUNK):
                silent = np.flatnonzero((rows[:, at : at + CHUNK] == 0).all(axis=1))
                for k in range(at, min(at + CHUNK, rows.shape[1])):
                    state[silent] = (state[silent] * a + c) & np.uint64(0xFFFFFFFF)
                    rows[silent, k] = np.where(state[silent] & np.uint64(SIGN_BIT), -level[silent], level[silent])
            yield pd.Series(list(rows))

    return filled(x, factor, seed)


def predictors(pairs: Column) -> Column:
    """Taps of a linear predictor from an even number of line-spectral cosines: half the sum of two products of quadratics."""

    @F.pandas_udf("array<double>")
    def multiplied(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if not len(batch):
                yield pd.Series([], dtype=object)
                continue
            x = np.stack(batch.to_numpy()).astype(float)
            total = 0.0
            for first, edge in ((0, 1.0), (1, -1.0)):
                poly = np.concatenate([np.ones((len(x), 1)), np.full((len(x), 1), edge)], axis=1)
                for k in range(first, x.shape[1], 2):
                    wide = np.pad(poly, ((0, 0), (2, 2)))
                    poly = wide[:, 2:] - 2.0 * x[:, k : k + 1] * wide[:, 1:-1] + wide[:, :-2]
                total = total + poly
            yield pd.Series(list(0.5 * total[:, 1 : x.shape[1] + 1]))

    return multiplied(pairs)


def noise_shaped(x: Column, old: Column, new: Column) -> Column:
    """``x`` shaped by the envelopes of two predictors, from one to the other through a first-order filter along the lines.

    There is one point of the envelopes for each line.
    """

    @F.pandas_udf("array<double>")
    def shaped(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for batch in batches:
            if not len(batch[0]):
                yield pd.Series([], dtype=object)
                continue
            lines, *taps = (np.stack(b.to_numpy()).astype(float) for b in batch)
            points, order = lines.shape[1], taps[0].shape[1]
            k = np.arange(1, order + 1)
            turn = SHRINK ** k[:, None] * np.exp(-1j * np.pi * k[:, None] * np.arange(points) / points)
            before, after = (1.0 / np.maximum(np.abs(1.0 + t @ turn), 1e-9) for t in taps)
            total = np.maximum(before + after, 1e-9)
            ahead, back = 2.0 * before * after / total, (after - before) / total
            out, last = np.empty_like(lines), np.zeros(len(lines))
            for i in range(points):
                last = ahead[:, i] * lines[:, i] + back[:, i] * last
                out[:, i] = last
            yield pd.Series(list(out))

    return shaped(x, old, new)


def whitened(series: DataFrame, by: str, order: str, width: float) -> DataFrame:
    """``series`` (by, order, re, im) with wre, wim: the rest of a second-order complex linear prediction along ``order``.

    The predictor of each key comes from five sums over pairs of neighbours; its taps shrink by ``width`` and its
    square. A key whose sums give no stable predictor stays as it is.
    """
    w = Window.partitionBy(by).orderBy(order)
    rows = series.withColumns({f"{c}{k}": F.lag(c, k).over(w) for c in ("re", "im") for k in (1, 2)})
    norm = lambda k: F.col(f"re{k}") * F.col(f"re{k}") + F.col(f"im{k}") * F.col(f"im{k}")
    inner = lambda a, b: (F.col(f"re{a}") * F.col(f"re{b}") + F.col(f"im{a}") * F.col(f"im{b}"), F.col(f"im{a}") * F.col(f"re{b}") - F.col(f"re{a}") * F.col(f"im{b}"))
    sums = {"e1": norm(1), "e2": norm(2)}
    for name, (a, b) in {"c": (1, 2), "p": ("", 1), "q": ("", 2)}.items():
        sums[name + "r"], sums[name + "i"] = inner(a, b)
    whole = F.col("re2").isNotNull()
    s = rows.where(whole).groupBy(by).agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    det = F.col("e1") * F.col("e2") - F.col("cr") * F.col("cr") - F.col("ci") * F.col("ci")
    taps = {
        "ar": (F.col("cr") * F.col("qr") + F.col("ci") * F.col("qi") - F.col("pr") * F.col("e2")) / det,
        "ai": (F.col("cr") * F.col("qi") - F.col("ci") * F.col("qr") - F.col("pi") * F.col("e2")) / det,
        "br": (F.col("cr") * F.col("pr") - F.col("ci") * F.col("pi") - F.col("qr") * F.col("e1")) / det,
        "bi": (F.col("cr") * F.col("pi") + F.col("ci") * F.col("pr") - F.col("qi") * F.col("e1")) / det,
    }
    good = (det > SINGULAR) & (taps["ar"] * taps["ar"] + taps["ai"] * taps["ai"] < UNSTABLE) & (taps["br"] * taps["br"] + taps["bi"] * taps["bi"] < UNSTABLE)
    solved = s.select(F.col(by).alias("__k"), *[F.when(good, t).otherwise(0.0).alias(k) for k, t in taps.items()])
    joined = rows.join(solved, F.col(by) == F.col("__k"), "left")
    one = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    wre = F.col("re") + width * (one("ar") * one("re1") - one("ai") * one("im1")) + width * width * (one("br") * one("re2") - one("bi") * one("im2"))
    wim = F.col("im") + width * (one("ar") * one("im1") + one("ai") * one("re1")) + width * width * (one("br") * one("im2") + one("bi") * one("re2"))
    return joined.select(by, order, "re", "im", wre.alias("wre"), wim.alias("wim"))
