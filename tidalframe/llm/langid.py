"""Operator 1: language identification by a byte convolutional network."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytetext
from .bytecnn import ByteCNN, windows_of
from .common import crc_mod, documents, dropped, share, shared_value
from .training import fit_cnn, sampled, training_windows

#: Sampled texts of each language, and windows of each text: what training is bounded by.
PER_LANGUAGE, WINDOWS = 600, 3
EPOCHS = 6
#: The pipeline lets texts go for which no language has half of the probability, or that have no letter.
LEAST_SCORE = 0.5

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[ord("A") : ord("Z") + 1] = True


def fit(texts: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], ByteCNN | None]:
    """Languages and network learned from (id, text, lang); null languages are left out.

    Each sampled window is an example of its own.
    """
    chosen, counts = sampled(texts.select("id", F.col("lang").alias("label")), per_language, seed=1)
    windows, doc, labels = training_windows(texts.select("id", "text"), chosen, WINDOWS)
    languages = sorted(set(labels))
    own = [labels[d] for d in doc]
    return languages, fit_cnn(windows, np.arange(len(own)), own, languages, counts, EPOCHS)


def _predicted(batches: Iterator[pa.RecordBatch], text_col: str, shared) -> Iterator[pa.RecordBatch]:
    languages, model = shared_value(shared)
    pairs = model.pairs() if model else None
    for batch in batches:
        for part in bytetext.parts(batch, text_col):
            data, offsets = bytetext.buffers(part.column(text_col))
            lang, score = ["und"] * len(part), np.zeros(len(part))
            letters = np.add.reduceat(np.append(_LETTER[data], False), np.minimum(offsets[:-1], len(data)), dtype=np.int64) * (np.diff(offsets) > 0)
            for i in np.flatnonzero(letters == 0):  # few: look for letters beyond ASCII
                raw = data[offsets[i] : offsets[i + 1]]
                letters[i] = (raw >= 128).any() and any(c.isalpha() for c in raw.tobytes().decode())
            if model:
                windows, doc = windows_of(data, offsets)
                features = model.pooled(windows, pairs)
                p = model.probabilities(np.concatenate([features, features], axis=1))
                weight = np.minimum(np.count_nonzero(windows[:, :-1], axis=1), windows.shape[1]) + 1e-9
                firsts = np.searchsorted(doc, np.arange(len(part)))
                p = np.add.reduceat(p * weight[:, None], firsts, axis=0) / np.add.reduceat(weight, firsts)[:, None]
                best = p.argmax(axis=1)
                for i in np.flatnonzero(letters):
                    lang[i], score[i] = languages[best[i]], min(1.0, float(p[i, best[i]]))
            yield pa.RecordBatch.from_pydict({c: part.column(c) for c in part.schema.names} | {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())})


def identify_languages(df: DataFrame, model: tuple[list[str], ByteCNN | None], text_col: str = "text") -> DataFrame:
    """``df`` with lang_pred and score, the mean probability over all windows of the whole text.

    A text that is null, empty or without a letter gets ``und`` and 0, and so does every text where
    nothing was learned. Equal probabilities go to the language that sorts first. Repeated rows are
    judged alike. Columns of ``df`` with the names of the new ones are replaced.
    """
    own = dropped(df, ["lang_pred", "score"])
    schema = T.StructType([*own.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = share(df.sparkSession, model)
    return own.mapInArrow(lambda batches: _predicted(batches, text_col, shared), schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(crc_mod("doc_id", 4) != 2).select(F.col("doc_id").alias("id"), "text", "lang")


def op1_langid(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from three folds of four."""
    docs = documents(spark, sf_dir)
    model = fit(training_rows(docs))
    out = identify_languages(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
