"""Operator 6: text quality by a byte convolutional network over overlapping chunks of the whole text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytetext
from .bytecnn import ByteCNN, text_features
from .common import crc_mod, documents, dropped, share, shared_value
from .training import fit_cnn, sampled, training_windows

#: Sampled texts of each label, and windows of each text: what training is bounded by. Nearly all texts have fewer windows.
PER_LABEL, WINDOWS = 900, 64
EPOCHS, RATE = 24, 0.02
THRESHOLD = 0.3
#: Windows of a chunk; a chunk starts at each window, so neighbours overlap by half.
CHUNK = 2


def fit(texts: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> ByteCNN | None:
    """A network learned from texts (id, text) and labels (id, label 0 or 1), on the features that are scored."""
    chosen, counts = sampled(labels, per_label, seed=6)
    windows, doc, own = training_windows(texts, chosen, WINDOWS)
    return fit_cnn(windows, doc, own, [0, 1], counts, EPOCHS, RATE, CHUNK)


def _scored(batches: Iterator[pa.RecordBatch], text_col: str, shared, threshold: float) -> Iterator[pa.RecordBatch]:
    model: ByteCNN | None = shared_value(shared)
    pairs = model.pairs() if model else None
    for batch in batches:
        for part in bytetext.parts(batch, text_col):
            score = np.full(len(part), 0.5)
            if model:
                data, offsets = bytetext.buffers(part.column(text_col))
                score = np.clip(model.probabilities(text_features(model, pairs, data, offsets, CHUNK))[:, 1].astype(np.float64), 0, 1)
            keep = {c: part.column(c) for c in part.schema.names}
            yield pa.RecordBatch.from_pydict(keep | {"score": pa.array(score, pa.float64()), "predicted": pa.array((score >= threshold).astype(np.int32), pa.int32())})


def score_quality(df: DataFrame, model: ByteCNN | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with score, the probability of label 1, and predicted.

    A null text scores as an empty one: one window of zeros. Without a model every score is 0.5.
    Repeated rows are judged alike. Columns of ``df`` with the names of the new ones are replaced.
    """
    own = dropped(df, ["score", "predicted"])
    schema = T.StructType([*own.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = share(df.sparkSession, model)
    return own.mapInArrow(lambda batches: _scored(batches, text_col, shared, threshold), schema)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from four folds of five."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_mod("doc_id", 5) != 0)
    model = fit(docs.select(F.col("doc_id").alias("id"), "text"), labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("label")))
    return score_quality(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
