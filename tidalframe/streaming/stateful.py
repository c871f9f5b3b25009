"""Streaming twins of the ordered operators: state of a key is kept, rows are not."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..sources.frames import FRAME_FIELDS, Scanner


def stream_frames(chunks: DataFrame, key: str = "stream", seq: str = "seq", data: str = "chunk") -> DataFrame:
    """Frames of chunked byte streams (key, seq, chunk), whatever the chunks' sizes.

    Chunks of one micro-batch are ordered by ``seq``; those of a later batch must come later. The state
    is the unfinished tail, its offset and two counters.
    """
    out = T.StructType([chunks.schema[key], *FRAME_FIELDS])
    state = T.StructType([T.StructField("held", T.BinaryType()), T.StructField("offset", T.LongType()), T.StructField("n", T.LongType()), T.StructField("discarded", T.LongType())])

    def advance(keys, pdfs: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        scanner = Scanner(*([bytes(held.get[0]), *held.get[1:]] if held.exists else []))
        rows = pd.concat(list(pdfs)).sort_values(seq)
        found = [f for piece in rows[data] for f in scanner.push(bytes(piece))]
        held.update(scanner.state())
        frame = pd.DataFrame(found, columns=[f.name for f in FRAME_FIELDS])
        frame.insert(0, key, keys[0])
        yield frame

    return chunks.groupBy(key).applyInPandasWithState(advance, out, state, "append", "NoTimeout")


def stream_scan(rows: DataFrame, key: str, order: str, columns: list[str], start: tuple, state_fields: list[T.StructField], step: Callable, fields: list[T.StructField]) -> DataFrame:
    """The recurrence of ``ordered_scan`` over a stream: ``step(state, row)`` with a tuple as state."""
    out = T.StructType([rows.schema[key], rows.schema[order], *fields])

    def advance(keys, pdfs: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = tuple(held.get) if held.exists else start
        frame = pd.concat(list(pdfs)).sort_values(order)
        made = []
        for row in frame[columns].itertuples(index=False, name=None):
            state, values = step(state, row)
            made.append(values)
        held.update(state)
        result = pd.DataFrame(made, columns=[f.name for f in fields])
        result.insert(0, order, frame[order].to_numpy())
        result.insert(0, key, keys[0])
        yield result

    return rows.groupBy(key).applyInPandasWithState(advance, out, T.StructType(state_fields), "append", "NoTimeout")


def stream_reservoir(units: DataFrame, nominal: int, capacity: int) -> DataFrame:
    """(unit, sub, fullness) over a stream of (unit, sub, bits)."""

    def step(state: tuple, row: tuple) -> tuple:
        full = min(capacity, state[0] + nominal - int(row[0]))
        return (full,), (full,)

    return stream_scan(units, "unit", "sub", ["bits"], (0,), [T.StructField("f", T.LongType())], step, [T.StructField("fullness", T.LongType())])


def stream_block_states(ratios: DataFrame, threshold: float) -> DataFrame:
    """(stream, t, state) over a stream of (stream, t, ratio)."""

    def step(state: tuple, row: tuple) -> tuple:
        attack, s = row[0] >= threshold, state[0]
        s = "short" if s == "start" else ("short" if attack else "stop") if s == "short" else ("start" if attack else "long")
        return (s,), (s,)

    return stream_scan(ratios, "stream", "t", ["ratio"], ("long",), [T.StructField("s", T.StringType())], step, [T.StructField("state", T.StringType())])
