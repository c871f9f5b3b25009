"""Operator 5: token counts through a cache that is keyed by digests.

The cache is a Parquet table of (content digest, tokenizer digest, bytes, tokens). Digests are held
against it first, and only texts that it lacks move, reduced to distinct ones before and after one
shuffle; they are encoded and appended, and all rows get their counts by joining the cache.

A byte-level BPE in a tokenizers file is encoded by tiktoken with the same vocabulary, which is about
eight times as fast; a worker first compares both libraries on probes and else uses tokenizers. The
tests compare them on many more texts.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, dropped, scratch_path, worker_state, written

LIMIT = 1024
#: Digests that a cache lacks are broadcast to the texts up to this number; more are joined by a shuffle.
BROADCAST_MISSES = 1_000_000
#: What the cut of a byte-level BPE into words must be for the fast way.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PROBES = ("", "Hello  world's\n\n tab\t12,345 é中😀 <|endoftext|>x", "  　a‍b\r\n", "zzzz" * 50 + " don't WE'LL", "a <|endof text|> <|endoftext|><|endoftext|>")

_CACHE = T.StructType([T.StructField("content", T.BinaryType()), T.StructField("tokenizer", T.StringType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies spell bytes as printable characters: others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _fast(path: str) -> Callable[[str], int] | None:
    import tiktoken

    spec = json.load(open(path, encoding="utf-8"))
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if not level or spec.get("normalizer") or model.get("type") != "BPE" or any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") for a in spec["added_tokens"]):
        return None
    byte, special = _byte_of(), {a["content"]: a["id"] for a in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    encoding = tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)
    allowed = set(special)
    return lambda text: len(encoding.encode(text, allowed_special=allowed, disallowed_special=()))


def engine(path: str) -> Callable[[str], int]:
    """Counts the tokens of a text as the file's own library does."""
    engines = worker_state().setdefault("engines", {})
    if path not in engines:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            engines[path] = lambda text: len(model.encode(text, num_threads=1))
        else:
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(path)
            slow.no_truncation()
            slow.no_padding()
            count = lambda text: len(slow.encode(text, add_special_tokens=False).ids)
            fast = _fast(path)
            engines[path] = fast if fast and all(fast(p) == count(p) for p in PROBES) else count
    return engines[path]


def version(path: str) -> str:
    """Digest of a tokenizer's file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    count = engine(path)
    for batch in batches:
        tokens = [count(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_pydict({"content": batch.column("content"), "tokenizer": batch.column("tokenizer"), "n_bytes": batch.column("n_bytes"), "n_tokens": pa.array(tokens, pa.int64())})


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def count_tokens(df: DataFrame, tokenizer: str, cache: str, text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``df`` with n_bytes, n_tokens and over_limit.

    A null text counts as an empty one: no bytes, no tokens. Repeated texts are encoded once. ``cache``
    is a path in a shared store, made where it is missing; it may hold counts of several tokenizers,
    and of other tables. Counts appended twice, by runs at the same time, do no harm. An empty table
    gives no rows. Columns of ``df`` with the names of the new ones are replaced.
    """
    spark, tok = df.sparkSession, version(tokenizer)
    content = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = dropped(df, ["n_bytes", "n_tokens", "over_limit", "__content"])
    keyed = own.withColumns({"__content": F.unhex(F.sha2(content, 256)), "n_bytes": F.octet_length(content).cast("long")})

    def cached() -> DataFrame:
        return spark.read.schema(_CACHE).parquet(cache).where(F.col("tokenizer") == tok)

    texts = keyed.select(F.col("__content").alias("content"), content.alias("text"))
    if _exists(spark, cache):
        lacked = written(texts.select("content").distinct().join(cached().select("content"), "content", "left_anti"), "token-misses")
        few = lacked.count() <= BROADCAST_MISSES
        texts = texts.join(F.broadcast(lacked) if few else lacked, "content", "left_semi")
    misses = texts.groupBy("content").agg(F.first("text").alias("text")).select("content", F.lit(tok).alias("tokenizer"), F.octet_length("text").cast("long").alias("n_bytes"), "text")
    misses.mapInArrow(lambda batches: _encoded(batches, tokenizer), _CACHE).write.mode("append").parquet(cache)
    known = cached().groupBy(F.col("content").alias("__known")).agg(F.max("n_tokens").alias("n_tokens"))
    # A text may be a third of all rows: the planner can split the row side of this join.
    out = keyed.join(known, F.col("__content") == F.col("__known"), "left").withColumn("over_limit", F.col("n_tokens") > limit)
    return out.select(*[F.col(f"`{c}`") for c in own.columns], "n_bytes", "n_tokens", "over_limit")


def op5_tokens(spark, sf_dir: str) -> DataFrame:
    """Tokens of all documents, through a cache that starts empty."""
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), scratch_path(spark, "token-cache"))
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")
