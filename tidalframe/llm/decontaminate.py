"""Operator 10: benchmark decontamination by a broadcast hash set of word windows.

The benchmark's windows are hashed on the driver and broadcast in blocks of bounded size; items too long
for a block are cut into pieces that share words. Each task
scans its documents' words as byte arrays: a rolling hash gives every window's hash at once, a bitmap
drops nearly all, a search in the sorted hashes finds the candidates, and each candidate is verified
word by word before it counts. Documents are not shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytetext
from .common import documents, dropped, share, shared_value, written

#: Words of a window.
WINDOW = 8
#: UTF-8 bytes of benchmark text in one broadcast block; a larger benchmark takes several passes.
BLOCK_BYTES = 32_000_000
#: Windows found in documents whose items a worker remembers.
FOUND = 200_000
#: A document with this many items is contaminated.
MIN_ITEMS = 2

_WORD_BYTES = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_OWN = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "clean_text"]


def words_of(text: str | bytes | None) -> list[bytes]:
    """Words of a text: lower-cased A-Z, cut at ASCII that is no digit or letter."""
    if text is None:
        return []
    raw = text.encode() if isinstance(text, str) else text
    return _WORD_BYTES.findall(raw.lower())


class Windows:
    """The windows of some benchmark items: sorted hashes, and the place of each in one buffer of texts to verify with.

    A window takes about 40 bytes, its words included.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], size: int = WINDOW):
        self.ids: list[str | None] = list(dict.fromkeys(i for i, _ in items))
        place = {i: k for k, i in enumerate(self.ids)}
        self.found: dict[bytes, tuple[str, ...] | None] = {}
        texts, starts, ends, hashes, owner, firsts = [], [], [], [], [], [0]
        at = 0
        for item, text in items:
            low = bytetext.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
            own = bytetext.runs(bytetext.ALNUM[low], np.zeros(0, np.int64))
            if not len(own[0]):
                continue
            texts.append(low), starts.append(own[0] + at), ends.append(own[1] + at), hashes.append(bytetext.word_hashes(low, *own))
            owner.append(place[item]), firsts.append(firsts[-1] + len(own[0]))
            at += len(low)
        self.low = np.concatenate([np.zeros(0, np.uint8), *texts])
        self.starts, self.ends = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (starts, ends))
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        lengths: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for k, h in enumerate(hashes):
            n = min(size, len(h))
            keys = bytetext.window_hashes(h, n)
            lengths.setdefault(n, []).append((keys, firsts[k] + np.arange(len(keys)), np.full(len(keys), owner[k], np.int32)))
        for n, rows in lengths.items():
            keys, word, item = (np.concatenate(x) for x in zip(*rows, strict=True))
            order = np.lexsort((word, item, keys))
            keys, word, item = keys[order], word[order], item[order]
            bits = max(10, min(24, int(len(keys) * 64).bit_length()))
            bitmap = np.zeros(1 << bits, bool)
            bitmap[keys >> np.uint64(64 - bits)] = True
            self.by_length[n] = (keys, bitmap, word, item)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"found": {}}

    def words(self, first: int, n: int) -> bytes:
        return b" ".join([self.low[self.starts[w] : self.ends[w]].tobytes() for w in range(first, first + n)])

    def items_of(self, words: bytes, n: int, key: np.uint64) -> tuple[str, ...] | None:
        """The items that hold the window, those without an id left out; None if none holds it."""
        if words not in self.found:
            keys, _, word, item = self.by_length[n]
            low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            same, seen = set(), set()
            for k in range(low, high):  # an item's equal windows are neighbours: the first one speaks for them unless hashes collide
                if int(item[k]) not in same and self.words(int(word[k]), n) == words:
                    same.add(int(item[k]))
            seen = {self.ids[i] for i in same}
            if len(self.found) > FOUND:
                self.found.clear()
            self.found[words] = tuple(sorted(seen - {None})) if seen else None
        return self.found[words]


def _scan(windows: Windows, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, tuple[str, ...]]]:
    """(first word, words, items) of every verified occurrence; windows don't cross documents."""
    out = []
    if not len(starts):
        return out
    hashes = bytetext.word_hashes(low, starts, ends)
    for n, (known, bitmap, _, _) in windows.by_length.items():
        if len(starts) < n:
            continue
        h = bytetext.window_hashes(hashes, n)
        maybe = np.flatnonzero(bitmap[h >> np.uint64(64 - int(len(bitmap)).bit_length() + 1)])
        maybe = maybe[doc[maybe] == doc[maybe + n - 1]]
        at = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
        for t in maybe[known[at] == h[maybe]].tolist():
            words = b" ".join(_WORD_BYTES.findall(low[starts[t] : ends[t + n - 1]].tobytes()))
            items = windows.items_of(words, n, h[t])
            if items is not None:
                out.append((t, n, items))
    return out


def _scan_batches(batches: Iterator[pa.RecordBatch], text_col: str, shared, first: bool, last: bool, min_items: int, clean: bool) -> Iterator[pa.RecordBatch]:
    windows: Windows = shared_value(shared)
    for batch in batches:
        for part in bytetext.parts(batch, text_col):
            yield _marked(part, text_col, windows, first, last, min_items, clean)


def _marked(batch: pa.RecordBatch, text_col: str, windows: Windows, first: bool, last: bool, min_items: int, clean: bool) -> pa.RecordBatch:
    data, offsets = bytetext.buffers(batch.column(text_col))
    low = bytetext.LOWER[data]
    starts, ends = bytetext.runs(bytetext.ALNUM[low], offsets)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    n = len(batch)
    first_word = np.searchsorted(doc, np.arange(n + 1))
    hits: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    items: list[set[str]] = [set() for _ in range(n)]
    if not first:
        for d, (s, i) in enumerate(zip(batch.column("__spans").to_pylist(), batch.column("__items").to_pylist(), strict=True)):
            hits[d] = [(s[k], s[k + 1]) for k in range(0, len(s), 2)]
            items[d] = set(i)
    for t, length, found in _scan(windows, low, starts, ends, doc):
        d = int(doc[t])
        at = t - int(first_word[d])
        if hits[d] and hits[d][-1][0] <= at <= hits[d][-1][1]:  # neighbours grow into one run
            hits[d][-1] = (hits[d][-1][0], max(hits[d][-1][1], at + length))
        else:
            hits[d].append((at, at + length))
        items[d].update(found)
    hits = [_merged(x) if len(x) > 1 else x for x in hits]
    keep = {c: batch.column(c) for c in batch.schema.names if c not in ("__spans", "__items")}
    if not last:
        keep["__spans"] = pa.array([[v for s in x for v in s] for x in hits], pa.list_(pa.int64()))
        keep["__items"] = pa.array([sorted(x) for x in items], pa.list_(pa.string()))
        return pa.RecordBatch.from_pydict(keep)
    counts = np.diff(first_word)
    keep["n_words"] = pa.array(counts, pa.int64())
    keep["n_hit"] = pa.array([sum(b - a for a, b in x) for x in hits], pa.int64())
    keep["n_items"] = pa.array([len(x) for x in items], pa.int64())
    empty = hashlib.sha256(b"").hexdigest()
    keep["items_sha256"] = pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() if x else empty for x in items], pa.string())
    keep["contaminated"] = pa.array([len(x) >= min_items for x in items], pa.bool_())
    if clean:
        keep["spans"] = pa.array([[v for s in x for v in s] for x in hits], pa.list_(pa.int64()))
        texts = batch.column(text_col)
        cleaned = [None] * n
        for d in range(n):
            if hits[d]:
                cleaned[d] = _without(data, offsets, starts, ends, int(first_word[d]), d, hits[d])
            else:
                cleaned[d] = texts[d].as_py()
        keep["clean_text"] = pa.array(cleaned, pa.string())
    return pa.RecordBatch.from_pydict(keep)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _without(data, offsets, starts, ends, first: int, d: int, spans: list[tuple[int, int]]) -> str:
    kept, at = [], int(offsets[d])
    for a, b in spans:
        kept.append(data[at : int(starts[first + a])].tobytes())
        at = int(ends[first + b - 1])
    kept.append(data[at : int(offsets[d + 1])].tobytes())
    return b"".join(kept).decode()


def _cut(batches: Iterator[pa.RecordBatch], size: int, most: int) -> Iterator[pa.RecordBatch]:
    """(i, t) in pieces of about ``most`` bytes; neighbours share words, so every window lies in one piece."""
    for batch in batches:
        ids, texts = [], []
        for i, t in zip(batch.column("i").to_pylist(), batch.column("t").to_pylist(), strict=True):
            raw = (t or "").encode()
            if len(raw) <= most:
                ids.append(i), texts.append(t)
                continue
            starts, ends = bytetext.runs(bytetext.ALNUM[bytetext.LOWER[np.frombuffer(raw, np.uint8)]], np.zeros(0, np.int64))
            first = 0
            while first < len(starts):
                last = max(first + 2 * size, int(np.searchsorted(ends, starts[first] + most, side="right")))
                last = len(starts) if len(starts) - last < size else last
                ids.append(i), texts.append(raw[starts[first] : ends[last - 1]].decode())
                first = last if last == len(starts) else last - size + 1
        yield pa.RecordBatch.from_pydict({"i": pa.array(ids, pa.string()), "t": pa.array(texts, pa.string())})


def blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int = BLOCK_BYTES, size: int = WINDOW) -> Iterator[list[tuple[str | None, str | None]]]:
    """The benchmark's items in lists of about ``limit`` bytes, each read by its own job; long items go in pieces."""
    rows = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").alias("t"))
    n = max(1, -(-(rows.agg(F.sum(F.octet_length("t"))).collect()[0][0] or 0) // limit))
    rows = rows.mapInArrow(lambda batches: _cut(batches, size, max(1, limit // 8)), "i string, t string")
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        yield sorted(((r.i, r.t) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or "", r[1] or ""))


def decontaminate(
    df: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    min_items: int = MIN_ITEMS,
    clean: bool = False,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``df`` with n_words, n_hit, n_items, items_sha256 and contaminated; with ``clean`` also spans
    (pairs of word numbers, end exclusive) and clean_text, the text without its hit spans.

    A null text has no words and stays null in clean_text; an empty one has none either. Items without
    words match nothing; the words of an item with a null id are hit, but it counts for no item. Repeated items with the same id count once, with different
    texts under one id too. Repeated documents are judged alike. An empty benchmark hits nothing.
    Columns of ``df`` with the names of the new ones are replaced. A benchmark over ``block_bytes``
    is applied block after block, the hits so far carried along in a written table.
    """
    out = dropped(df, _OWN + ["__spans", "__items"])
    spark = df.sparkSession
    todo = blocks(benchmark, item_col, item_text_col, block_bytes, window)
    block, first = next(todo), True
    while block is not None:
        following = next(todo, None)
        last = following is None
        fields = [f for f in out.schema.fields if f.name not in ("__spans", "__items")]
        if last:
            fields += [T.StructField(n, T.LongType()) for n in ("n_words", "n_hit", "n_items")]
            fields += [T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())]
            if clean:
                fields += [T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("clean_text", T.StringType())]
        else:
            fields += [T.StructField("__spans", T.ArrayType(T.LongType())), T.StructField("__items", T.ArrayType(T.StringType()))]
        shared = share(spark, Windows(block, window))

        def scan(batches, shared=shared, first=first, last=last):
            return _scan_batches(batches, text_col, shared, first, last, min_items, clean)

        out = out.mapInArrow(scan, T.StructType(fields))
        if not last:
            out = written(out, "decontaminate")
        block, first = following, False
    return out


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All documents held against all benchmark items."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The same by plain joins of all windows.
OP10_SQL = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce({_WORDS.format(t="text")}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, coalesce({_WORDS.format(t="text")}, []) AS w FROM benchmark),
k AS (SELECT DISTINCT item, n, array_to_string(w[i + 1:i + n], ' ') AS k FROM (SELECT item, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM (SELECT *, least(8, len(w)) AS n FROM b WHERE len(w) > 0))),
o AS (SELECT r, i, n, array_to_string(w[i + 1:i + n], ' ') AS k FROM (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM k) WHERE len(w) >= n)),
h AS (SELECT o.r, o.i, o.n, k.item FROM o JOIN k ON k.n = o.n AND k.k = o.k),
p AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)"""
