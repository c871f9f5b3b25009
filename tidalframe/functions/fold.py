"""Recurrences over ordered rows, batch by batch in Arrow, one group's rows in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ordered_scan(df: DataFrame, by: str, order: list[str], columns: list[str], start: Callable[[], object], step: Callable, fields: list[T.StructField]) -> DataFrame:
    """``df``'s key, order and ``columns`` with the fields that ``step`` gives for each row in order.

    ``step(state, row)`` gets a group's state and a tuple of ``columns`` and returns (state, values).
    Rows are hash-partitioned by the key and sorted in each partition by Spark, which spills; Python
    sees batches and keeps one state, so neither a group nor a partition has to fit in memory.
    """
    own = [by, *order, *[c for c in columns if c not in (by, *order)]]
    schema = T.StructType([*[df.schema[c] for c in own], *fields])
    # The key and two tests: a batch may end inside a group.
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = None, object()
        for batch in batches:
            keys = batch.column(by).to_pylist()
            values = zip(*[batch.column(c).to_pylist() for c in columns], strict=True)
            out = []
            for key, row in zip(keys, values, strict=True):
                if key != last:
                    state, last = start(), key
                state, made = step(state, row)
                out.append(made)
            made_columns = list(zip(*out, strict=True)) if out else [[] for _ in fields]
            arrays = [pa.array(list(c), type=_arrow(f.dataType)) for c, f in zip(made_columns, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in own] + arrays, names=own + [f.name for f in fields])

    return df.select(*own).repartition(F.col(by)).sortWithinPartitions(by, *order).mapInArrow(scan, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}[kind.simpleString()]
