"""Operator 7: toxicity by class-conditional Kneser-Ney models over the letters of words.

Every labelled text of the training folds is counted: n-grams of bytes inside words, by class, summed
up in the tasks and then by a shuffle whose size follows the corpus. Both classes discount their own
counts and back off to one shared Kneser-Ney model of shorter n-grams, built from the number of
different n-grams that each one continues, so an expression that is rare in either class leans on what
all texts show. The log-likelihood ratio of each n-gram follows by joins and goes into exact tables,
none left out, which are broadcast in blocks. A text's ratios are added up by word and divided by the
number of words: all ratios, and those parts of them that go beyond some levels, so that a few strong
words count in a long text. A logistic curve, fitted on training rows that the counts don't hold,
turns these into a probability.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytetext
from .common import crc_mod, documents, dropped, share, worker_state, written
from .training import one_of_each_id, sampled

#: Bytes of an n-gram, the predicted one included; with its class mark and CONTEXT it has to fit a long.
ORDER = 7
DISCOUNT = 0.75
CONCENTRATION = 5.0
#: Ratios of a word beyond which it counts as evidence.
EVIDENCE = (1.0, 3.0)
#: Marks the key of a context; n-grams lie below.
CONTEXT = 1 << 8 * ORDER
#: N-grams and contexts of a broadcast block at most, about: 12 bytes each, of which the driver holds a few copies.
BLOCK = 1 << 19
#: Texts of each class that the logistic curve is fitted on.
PER_CLASS = 3000
#: Labels up to this number are broadcast to the scan of the texts; more are joined by a shuffle.
BROADCAST_LABELS = 2_000_000
THRESHOLD = 0.5
#: Distinct n-grams that a task holds before it passes them on.
HELD = 2_000_000


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-grams of all words as packed integers, the word of each, and the text of each word.

    A word is a run of lower-cased letters, digits and bytes beyond ASCII. Its n-grams predict each of
    its bytes and its end, from the bytes before in the same word, the first of them its start.
    """
    low = bytetext.LOWER[data]
    starts, ends = bytetext.runs(bytetext.ALNUM[low], offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = ends - starts
    word = np.repeat(np.arange(len(starts)), sizes + 1)
    first = np.cumsum(sizes + 1) - (sizes + 1)
    place = np.arange(len(word)) - first[word]  # in the word; its length at the end mark
    stream = np.full(len(word) + 1, 32, np.int64)
    inside = place < sizes[word]
    stream[1:][inside] = low[(starts[word] + place)[inside]]
    out = stream[1:].copy()
    for k in range(1, ORDER):
        before = np.zeros(len(word), np.int64)
        before[k - 1 :] = stream[: len(word) - k + 1]
        out |= np.where(place >= k - 1, before, 0) << (8 * k)
    return out, word, np.searchsorted(offsets, starts, side="right") - 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)

    def merged(gram: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(gram, kind="stable")
        gram, counts = gram[order], counts[order]
        firsts = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, int)
        return gram[firsts], (np.add.reduceat(counts, firsts, axis=0) if len(firsts) else counts)

    def sent(gram: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"g": pa.array(gram, pa.int64()), "t": pa.array(counts[:, 1], pa.int64()), "o": pa.array(counts[:, 0], pa.int64())})

    for batch in batches:
        for part in bytetext.parts(batch, "text"):
            toxic = np.asarray(part.column("label")).astype(bool)
            gram, word, text = grams(*bytetext.buffers(part.column("text")))
            if not len(gram):
                continue
            own = toxic[text][word].astype(np.int64)
            both, n = np.unique(gram * 2 + own, return_counts=True)
            counts = np.zeros((len(both), 2), np.int64)
            counts[np.arange(len(both)), both & 1] = n
            held = merged(np.concatenate([held[0], both >> 1]), np.concatenate([held[1], counts]))
            if len(held[0]) > HELD:
                yield sent(*held)
                held = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    yield sent(*held)


def _kneser_ney(level: DataFrame, size: int, below: DataFrame | None) -> DataFrame:
    """Columns of ``level`` (g, n and others) and p: discounted counts over the shorter model ``below``."""
    context = level.groupBy(F.shiftright("g", 8).alias("c")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    joined = level.withColumn("c", F.shiftright("g", 8)).join(context, "c")
    if below is not None:
        joined = joined.withColumn("s", F.col("g").bitwiseAND(F.lit((1 << (8 * (size - 1))) - 1)))
        joined = joined.join(below.select(F.col("g").alias("s"), F.col("p").alias("q")), "s", "left")
    q = F.lit(1 / 256) if below is None else F.coalesce("q", F.lit(1 / 256))
    p = (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * q) / F.col("total")
    return joined.select(*level.columns, p.alias("p"))


def shared_model(counts: DataFrame) -> DataFrame:
    """``counts`` (g, t, o) with p: the Kneser-Ney probability of each n-gram in all texts together.

    The longest n-grams have the counts of both classes; a shorter one counts the different n-grams of
    the next length that end in it. Each length is written, its counts and its model: in one plan every use of
    a length would build all longer ones anew, and the driver hold the square of the lengths in stages.
    """
    levels, now = [], counts
    for size in range(ORDER - 1, 0, -1):
        mask = (1 << (8 * size)) - 1
        now = written(now.groupBy(F.col("g").bitwiseAND(F.lit(mask)).alias("g")).agg(F.count("*").alias("n")), "ngram-levels")
        levels.append((size, now))
    below = None
    for size, level in reversed(levels):
        below = written(_kneser_ney(level, size, below), "ngram-model")
    return _kneser_ney(counts.withColumn("n", F.col("t") + F.col("o")), ORDER, below)


def ratios(counts: DataFrame) -> DataFrame:
    """(key, ratio, n): log-likelihood ratio, toxic over ordinary, of each counted n-gram.

    Both classes discount their own counts and give the rest, and as much again as CONCENTRATION
    observations, to the shared model: Kneser-Ney smoothing in its Pitman-Yor form.
    """
    own = _contexts(counts)
    joined = shared_model(counts).withColumn("c", F.shiftright("g", 8)).join(own, "c")

    def likelihood(n: str, total: str, kinds: str) -> Column:
        rest = DISCOUNT * F.col(kinds) + CONCENTRATION
        return (F.greatest(F.col(n) - DISCOUNT, F.lit(0.0)) + rest * F.col("p")) / (F.col(total) + CONCENTRATION)

    return joined.select(F.col("g").alias("key"), F.log(likelihood("t", "ct", "kt") / likelihood("o", "co", "ko")).alias("ratio"), "n")


def _contexts(counts: DataFrame) -> DataFrame:
    return counts.groupBy(F.shiftright("g", 8).alias("c")).agg(
        F.sum("t").alias("ct"), F.sum("o").alias("co"), F.count_if(F.col("t") > 0).alias("kt"), F.count_if(F.col("o") > 0).alias("ko")
    )


def backed_off(counts: DataFrame) -> DataFrame:
    """(key, ratio): for each counted context the ratio of all n-grams that continue it and that no one counted.

    Both classes back off to the same shared probability of the last byte, which their ratio doesn't
    keep: what is left are the shares that the classes give away. After a context that no one counted
    both give all, and the ratio is 0.
    """

    def rest(total: str, kinds: str) -> Column:
        return (DISCOUNT * F.col(kinds) + CONCENTRATION) / (F.col(total) + CONCENTRATION)

    return _contexts(counts).select(F.col("c").bitwiseOR(F.lit(CONTEXT)).alias("key"), F.log(rest("ct", "kt") / rest("co", "ko")).alias("ratio"))


def _slot(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    seed = np.uint64((0x9E3779B97F4A7C15 + 2 * level * 0xD1B54A32D192ED03) % (1 << 64))
    h = bytetext.mixed(keys.astype(np.uint64) * seed)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


class Ratios:
    """Ratios of all given n-grams: levels of slots with whole keys, each for what finds its slot taken in the one before.

    A level has at least twice as many slots as keys are left, so a few levels hold all.
    """

    def __init__(self, rows: Iterable[tuple[np.ndarray, np.ndarray]]):
        parts = list(rows)
        keys = np.concatenate([np.zeros(0, np.int64), *[k for k, _ in parts]]).astype(np.int64)
        value = np.concatenate([np.zeros(0, np.float32), *[v for _, v in parts]]).astype(np.float32)
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        while len(keys):
            bits = max(4, int(2 * len(keys) - 1).bit_length())
            held, own = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.float32)
            slot = _slot(keys, len(self.levels), bits)
            held[slot] = keys
            placed = held[slot] == keys
            own[slot[placed]] = value[placed]
            self.levels.append((bits, held, own))
            keys, value = keys[~placed], value[~placed]

    def of(self, gram: np.ndarray) -> np.ndarray:
        """The ratio of each n-gram; 0 where there is none."""
        return self.found(gram)[0]

    def found(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ratio of each n-gram, and whether there is one."""
        out, known = np.zeros(len(gram), np.float32), np.zeros(len(gram), bool)
        left = None  # places of the n-grams whose slot another one holds; first all
        for level, (bits, held, own) in enumerate(self.levels):
            now = gram if left is None else gram[left]
            slot = _slot(now, level, bits)
            key = held[slot]
            same = key == now
            if left is None:
                out, known = np.where(same, own[slot], np.float32(0)), same
                left = np.flatnonzero(~same & (key >= 0))
            else:
                out[left[same]] = own[slot[same]]
                known[left[same]] = True
                left = left[~same & (key >= 0)]
        return out, known


def _tables(found: DataFrame) -> list:
    """Keys and ratios of all n-grams and contexts in broadcasts of about BLOCK; the driver holds one block at a time and builds no table of it."""
    found = written(found.select("key", F.col("ratio").cast("float").alias("ratio")), "ratios")
    blocks = max(1, -(-found.count() // BLOCK))
    out = []
    for b in range(blocks):
        got = found.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).toArrow()
        out.append(share(found.sparkSession, (np.asarray(got["key"]), np.asarray(got["ratio"]))))
    return out


def _ratios_of(tables: list) -> Ratios:
    """One table of all blocks, 24 to 60 bytes an n-gram; a worker keeps the last one from task to task."""
    state, packed = worker_state(), [t.value for t in tables]
    known = state.get("ratios", ((), None))
    if len(known[0]) != len(packed) or any(a is not b for a, b in zip(known[0], packed, strict=True)):
        known = state["ratios"] = packed, Ratios(cloudpickle.loads(p) for p in packed)
    return known[1]


def _ratio(tables: list, gram: np.ndarray) -> np.ndarray:
    """The ratio of each n-gram: its own if it was counted, else that of its context, else 0."""
    ratios = _ratios_of(tables)
    value, known = ratios.found(gram)
    out, new = value.astype(np.float64), np.flatnonzero(~known)
    if len(new):
        out[new] = ratios.of(gram[new] >> 8 | CONTEXT)
    return out


def _features(tables: list, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text: ratio a word, and the root of what goes beyond each level of EVIDENCE, a word; 0 without words."""
    n = len(offsets) - 1
    out = np.zeros((n, 1 + len(EVIDENCE)))
    gram, word, text = grams(data, offsets)
    if not len(gram):
        return out
    by_word = np.add.reduceat(_ratio(tables, gram), np.searchsorted(word, np.arange(len(text))))
    sizes = np.maximum(np.bincount(text, minlength=n), 1)
    out[:, 0] = np.bincount(text, weights=by_word, minlength=n) / sizes
    for k, level in enumerate(EVIDENCE):
        out[:, 1 + k] = np.sqrt(np.bincount(text, weights=np.maximum(by_word - level, 0), minlength=n) / sizes)
    return out


def _featured(batches: Iterator[pa.RecordBatch], tables: list) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in bytetext.parts(batch, "text"):
            f = _features(tables, *bytetext.buffers(part.column("text")))
            yield pa.RecordBatch.from_pydict({"id": part.column("id"), "label": part.column("label"), "features": pa.array(f.tolist(), pa.list_(pa.float64()))})


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and spread of the features, and weights of a logistic curve, by Newton's steps."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    b = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        gradient = z.T @ (w * (p - y)) + 1e-2 * b
        hessian = (z * (w * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(b))
        step = np.linalg.solve(hessian, gradient)
        b -= np.clip(step, -2, 2)
    return mean, spread, b


def _joined(texts: DataFrame, labels: DataFrame) -> DataFrame:
    few = labels.count() <= BROADCAST_LABELS
    return texts.join(F.broadcast(labels) if few else labels, "id").select("label", "text")


def fit(texts: DataFrame, labels: DataFrame, per_class: int = PER_CLASS):
    """Ratios and logistic curve from texts (id, text) and labels (id, label 0 or 1); None without both classes.

    A fifth of the labels, by hash, is left out of the counts: a bounded sample of it fits the curve.
    """
    labels = labels.where("id is not null and label is not null").select("id", F.col("label").cast("int").alias("label")).distinct()
    fold = F.pmod(F.xxhash64("id", F.lit(77)), F.lit(5))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("g", "t", "o")])
    partial = _joined(texts, labels.where(fold != 0)).mapInArrow(_counted, schema)
    counts = written(partial.groupBy("g").agg(F.sum("t").alias("t"), F.sum("o").alias("o")), "ngrams")
    tables = _tables(ratios(counts).select("key", "ratio").union(backed_off(counts)))
    chosen, sizes = sampled(labels.where(fold == 0), per_class, seed=7)
    kinds = T.StructType([texts.schema["id"], T.StructField("label", T.IntegerType()), T.StructField("features", T.ArrayType(T.DoubleType()))])
    found = texts.join(F.broadcast(chosen), "id").select("id", "label", "text").mapInArrow(lambda b: _featured(b, tables), kinds)
    rows = one_of_each_id(found, "features").orderBy("id", "label").collect()  # at most per_class of each label
    y = np.array([r.label for r in rows], float)
    if not len(y) or y.min() == y.max():
        return None
    x = np.array([r.features for r in rows])
    w = np.where(y > 0, sizes.get(1, 1) / max(1, y.sum()), sizes.get(0, 1) / max(1, (1 - y).sum()))
    return tables, _logistic(x, y, w / w.mean())


def _scored(batches: Iterator[pa.RecordBatch], text_col: str, model, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in bytetext.parts(batch, text_col):
            score = np.zeros(len(part))
            if model is not None:
                tables, (mean, spread, b) = model
                x = _features(tables, *bytetext.buffers(part.column(text_col)))
                score = 1 / (1 + np.exp(-np.clip(b[0] + ((x - mean) / spread) @ b[1:], -30, 30)))
            keep = {c: part.column(c) for c in part.schema.names}
            yield pa.RecordBatch.from_pydict(keep | {"score": pa.array(score, pa.float64()), "predicted": pa.array((score >= threshold).astype(np.int32), pa.int32())})


def score_toxicity(df: DataFrame, model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with score, the probability of label 1, and predicted.

    Null, empty and wordless texts show no evidence: ratios of 0. Without a model every score is 0.
    Repeated rows are judged alike. Columns of ``df`` with the names of the new ones are replaced.
    """
    own = dropped(df, ["score", "predicted"])
    schema = T.StructType([*own.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return own.mapInArrow(lambda batches: _scored(batches, text_col, model, threshold), schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from four folds of five."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_mod("doc_id", 5) != 0)
    model = fit(docs.select(F.col("doc_id").alias("id"), "text"), labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("label")))
    return score_toxicity(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
