"""Quantisation of bands and choice of sections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fold import ordered_scan

#: Range of scale factors, largest quantised magnitude, margin of the allowed noise.
LEAST_SCALE, MOST_SCALE, MOST_LEVEL, MARGIN = -120, 120, 8191, 1.25


_SCALES = np.arange(LEAST_SCALE, MOST_SCALE + 1)
_STEPS = np.power(2.0, 0.25 * _SCALES)


#: What each level stands for before its step: its power 4/3, a table by the rule.
_SIZES = np.power(np.arange(MOST_LEVEL + 1, dtype=float), 4.0 / 3.0)


def _levels(magnitude: np.ndarray, step) -> np.ndarray:
    """Magnitudes over the step to the power 3/4, by two roots, rounded half up, at most MOST_LEVEL."""
    ratio = magnitude / step
    return np.minimum(np.floor(np.sqrt(ratio * np.sqrt(ratio)) + 0.5), MOST_LEVEL)


#: Bands that are tried at once: a matrix of bands by scales by lines.
_TOGETHER = 64


def _chosen(x: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """The scale of each row of ``x``: the end of the first run of scales whose noise is allowed, else the finest; 0 of silence."""
    magnitude = np.abs(x)
    out = np.zeros(len(x), np.int64)
    for at in range(0, len(x), _TOGETHER):
        m = magnitude[at : at + _TOGETHER, None, :]
        levels = _levels(m, _STEPS[:, None])
        noise = ((m - _SIZES[levels.astype(np.intp)] * _STEPS[:, None]) ** 2).sum(axis=2)
        fits = noise <= np.maximum(allowed[at : at + _TOGETHER, None] / MARGIN, 1e-20)
        first = fits.argmax(axis=1)
        ends = ~fits & (np.arange(len(_SCALES)) > first[:, None])
        last = np.where(ends.any(axis=1), ends.argmax(axis=1) - 1, len(_SCALES) - 1)
        scale = np.where(fits.any(axis=1), _SCALES[last], LEAST_SCALE)
        out[at : at + _TOGETHER] = np.where((m > 1e-20).any(axis=(1, 2)), scale, 0)
    return out


def quantised_bands(bands: DataFrame) -> DataFrame:
    """``bands`` (..., x, allowed) with scale and levels: the end of the first run of scales that meet the noise.

    ``x`` holds a band's lines. All scales are tried as one small matrix in an Arrow batch, so nothing is
    exploded or shuffled. Where no scale will do the finest one is taken; a silent band has scale 0.
    """

    @F.pandas_udf("struct<scale: int, levels: array<int>>")
    def quantise(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for x, allowed in batches:
            scales, levels = np.zeros(len(x), np.int32), np.empty(len(x), object)
            sizes = np.array([len(v) for v in x], int)
            for n in np.unique(sizes):  # bands of one width together
                at = np.flatnonzero(sizes == n)
                v = np.stack(x.iloc[at].to_numpy()).astype(float)
                own = _chosen(v, allowed.iloc[at].to_numpy(float))
                q = (np.where(np.abs(v) <= 1e-20, 0, _levels(np.abs(v), np.power(2.0, 0.25 * own)[:, None])) * np.sign(v)).astype(np.int32)
                scales[at] = own
                for i, row in zip(at, q, strict=True):
                    levels[i] = row
            yield pd.DataFrame({"scale": scales, "levels": levels})

    rows = bands.withColumn("__q", quantise("x", "allowed"))
    return rows.withColumns({"scale": F.col("__q.scale"), "levels": F.col("__q.levels")}).drop("__q")


def section_costs(costs: DataFrame, choices: list[str], side: int) -> DataFrame:
    """(unit, total): least cost of covering a unit's positions with sections of one choice each.

    ``costs`` is (unit, sub, one column for each choice); a section adds ``side``. One ordered pass:
    for each choice the best way that ends in it.
    """

    def step(state: tuple | None, row: tuple) -> tuple:
        if state is None:
            new = tuple(side + c for c in row)
        else:
            best = min(state) + side
            new = tuple(min(s, best) + c for s, c in zip(state, row, strict=True))
        return new, (min(new),)

    out = ordered_scan(costs, "unit", ["sub"], choices, lambda: None, step, [T.StructField("total", T.LongType())])
    return out.groupBy("unit").agg(F.max_by("total", "sub").alias("total"))
