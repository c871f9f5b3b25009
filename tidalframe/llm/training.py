"""Bounded, repeatable samples of labelled texts for the classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytetext
from .bytecnn import ByteCNN, windows_of


def sampled(rows: DataFrame, per_class: int, seed: int = 0) -> tuple[DataFrame, dict]:
    """At most ``per_class`` different ids of each label from (id, label), drawn by hash; and all labels' counts of ids.

    Reruns draw the same ids; an id with several rows of one label counts once. First a share that leaves about
    twice as many as wanted, so what is then ranked is bounded however large a class is.
    """
    rows = rows.where("id is not null and label is not null").select("id", "label").distinct()
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    draw = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11) / F.lit(2.0**53)
    share = F.lit(0.0)
    for label, n in sorted(counts.items()):
        share = F.when(F.col("label") == F.lit(label), F.lit((2 * per_class + 50) / n)).otherwise(share)
    order = Window.partitionBy("label").orderBy("__u", "id")
    drawn = rows.withColumn("__u", draw).where(F.col("__u") < share)
    return drawn.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= per_class).select("id", "label"), counts


def _windows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Up to ``most`` windows of each text, evenly spread over all of it."""
    for batch in batches:
        data, offsets = bytetext.buffers(batch.column("text"))
        packed = []
        for i in range(len(batch)):
            own, _ = windows_of(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
            if len(own) > most:
                own = own[np.linspace(0, len(own) - 1, most).round().astype(int)]
            packed.append(own.tobytes())
        yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "label": batch.column("label"), "windows": pa.array(packed, pa.binary())})


def one_of_each_id(found: DataFrame, value: str) -> DataFrame:
    """One row of each (id, label) of ``found``, that with the least digest of ``value``; copies meet inside the tasks first."""
    best = F.min_by(value, F.xxhash64(value)).alias(value)
    return found.groupBy("id", "label").agg(best)


def training_windows(texts: DataFrame, chosen: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Windows of the chosen texts, the number of the text of each, and the texts' labels.

    ``texts`` has (id, text), ``chosen`` the bounded (id, label) of ``sampled``, so it may be broadcast. Of
    several texts with one id the one with the least digest is taken, so no more rows than chosen ones come back.
    """
    label = chosen.schema["label"].dataType
    schema = T.StructType([T.StructField("id", texts.schema["id"].dataType), T.StructField("label", label), T.StructField("windows", T.BinaryType())])
    found = texts.join(F.broadcast(chosen), "id").select("id", "label", "text").mapInArrow(lambda b: _windows(b, most), schema)
    rows = one_of_each_id(found, "windows").collect()
    rows.sort(key=lambda r: (r.id, bytes(r.windows)))
    if not rows:
        return np.zeros((0, 1), np.uint8), np.zeros(0, int), []
    width = windows_of(np.zeros(0, np.uint8), np.zeros(2, np.int64))[0].shape[1]
    windows = [np.frombuffer(bytes(r.windows), np.uint8).reshape(-1, width) for r in rows]
    return np.concatenate(windows), np.repeat(np.arange(len(rows)), [len(w) for w in windows]), [r.label for r in rows]


def fit_cnn(windows: np.ndarray, doc: np.ndarray, labels: list, classes: list, counts: dict, epochs: int, rate: float = 0.01, chunk: int = 1) -> ByteCNN | None:
    """A network for ``classes``, each sampled text weighing as many as its label stands for; None without texts."""
    if not labels:
        return None
    place = {c: i for i, c in enumerate(classes)}
    y = np.array([place[v] for v in labels])
    seen = np.bincount(y, minlength=len(classes))
    weights = np.array([counts[v] / seen[place[v]] for v in labels], np.float32)
    model = ByteCNN(len(classes))
    model.fit(windows, doc, y, weights / weights.mean(), epochs=epochs, rate=rate, chunk=chunk)
    return model
