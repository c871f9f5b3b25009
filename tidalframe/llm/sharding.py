"""Operator 9: histogram sort into shards of equal bytes, with DataFrame functions only.

Keys are the pair (hash of the text, hash of the id), so equal texts are neighbours. Splitters are
found by counting the exact bytes below candidate key boundaries: one histogram of the whole key
space, then finer and finer histograms of only those intervals that hold a boundary, until the
boundary meets the tolerance. What reaches the driver is the histogram, at most ``2**PROBE_BITS``
rows for each of the ``shards - 1`` boundaries, whatever the input. Rows are exchanged once, when the
slot numbers are dealt, by cells that are narrow everywhere: a cell that holds many copies of one
text is cut again by the hash of the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, dropped, shuffle_partitions, written

#: Probes of one refinement step, as a power of two.
PROBE_BITS = 12
#: A boundary between two texts is precise enough at this share of a shard's bytes.
TOLERANCE = 0.005
#: A boundary may miss its target by this share of a shard to keep equal texts together.
GROUP_TOLERANCE = 0.02


def _keys(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text, doc = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    return (
        dropped(df, ["size", "text_crc32", "__h", "__g"])
        .withColumn("size", F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1)
        .withColumn("text_crc32", F.coalesce(F.crc32(text), F.lit(0)).cast("long"))
        .withColumn("__h", F.xxhash64(F.coalesce(text, F.lit(""))))
        .withColumn("__g", F.xxhash64(doc))
    )


def _histogram(keys: DataFrame, spans: list[tuple[int, str, int | None, int, int]]) -> dict:
    """Exact bytes by probe. spans: (boundary, column, h or None, low, high), inclusive."""
    parts = []
    for k, col, h, low, high in spans:
        step = max(1, -(-(high - low + 1) // (1 << PROBE_BITS)))
        inside = F.col(col).between(F.lit(low), F.lit(high))
        if h is not None:
            inside = inside & (F.col("__h") == F.lit(h))
        if high - low < 2**62:
            probe = F.expr(f"(`{col}` - ({low}L)) div {step}L")
        else:  # the whole space of 64 bits: its high bits
            probe = F.shiftright(F.col(col), 64 - PROBE_BITS).cast("long")
        parts.append(F.when(inside, F.struct(F.lit(k).alias("k"), probe.alias("b"), F.col(col).alias("v"))))
    rows = (
        keys.select("size", F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("p"))
        .groupBy(F.col("p.k").alias("k"), F.col("p.b").alias("b"))
        .agg(F.sum("size").alias("bytes"), F.min("p.v").alias("low"), F.max("p.v").alias("high"))
        .collect()
    )
    out: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r.k, r.b)):
        out.setdefault(r.k, []).append((r.bytes, r.low, r.high))
    return out


def splitters(keys: DataFrame, shards: int) -> list[tuple[int, int]]:
    """For each boundary the least key (text hash, id hash) of the next shard.

    ``keys`` has size, __h and __g. Every step is one pass over ``keys`` that counts the bytes of all
    rows in the open intervals; the driver holds histograms only.
    """
    least, most = -(2**63), 2**63 - 1
    first = _histogram(keys, [(0, "__h", None, least, most)]).get(0, [])
    total = sum(b for b, _, _ in first)
    fair = total / shards
    found: dict[int, tuple[int, int]] = {}
    #: boundary -> (column, h, bytes below the interval, histogram of the interval)
    open_ = {k: ("__h", None, 0, first) for k in range(1, shards)} if first else {}
    while open_:
        spans = []
        state = {}
        for k, (col, h, below, hist) in open_.items():
            target, at = total * k / shards, below
            for n, low, high in hist:
                if at + n >= target:
                    break
                at += n
            # the target lies in this probe, which starts at key `low` with `at` bytes below it
            up = (at + n) - target
            down = target - at
            whole = col == "__h" and low == high  # one text and its copies
            limit = GROUP_TOLERANCE * fair if whole else TOLERANCE * fair
            if min(up, down) <= limit or (col == "__g" and low == high):
                if down <= up:
                    found[k] = (low, least) if col == "__h" else (h, low)
                elif col == "__h":
                    found[k] = (high + 1, least) if high < most else (most, most)
                else:
                    found[k] = (h, high + 1) if high < most else (h + 1, least)
            elif whole:
                spans.append((k, "__g", low, least, most))
                state[k] = ("__g", low, at)
            else:
                spans.append((k, col, h, low, high))
                state[k] = (col, h, at)
        if not spans:
            break
        hists = _histogram(keys, spans)
        open_ = {k: (*state[k], hists[k]) for k in state}
    return [found[k] for k in sorted(found)]


def _shard(bounds: list[tuple[int, int]]) -> Column:
    out = F.lit(0)
    for h, g in bounds:
        beyond = (F.col("__h") > F.lit(h)) | ((F.col("__h") == F.lit(h)) & (F.col("__g") >= F.lit(g)))
        out = out + beyond.cast("int")
    return out


def shard_documents(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with size, text_crc32, law, shard, slot and grown_shard; every row stays.

    Law ``bytes``: the shards' sizes (UTF-8 bytes plus 1 for each row) are near equal, to within
    ``GROUP_TOLERANCE`` of a shard or the largest row. Equal texts stay together unless their group is
    too large for that. Slots count 0, 1, 2, ... in each shard, in key order but for oversized groups.
    A null text counts no bytes and has crc32 0, as an empty one. Ties (rows equal in text and id)
    share a shard and get neighbouring slots in no stated order. An empty table gives no rows. Columns
    of ``df`` with the names of the new ones are replaced. grown_shard is null under this law.
    """
    names = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    keyed = _keys(dropped(df, names), id_col, text_col)
    keys = written(keyed.select("size", "__h", "__g"), "shard-keys")
    bounds = splitters(keys, shards)
    return _dealt(keyed, keys, bounds)


def _dealt(keyed: DataFrame, keys: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    spark = keyed.sparkSession
    shard, bucket = _shard(bounds), F.shiftright(F.col("__h"), 64 - PROBE_BITS).cast("int")
    cut = keys.select(shard.alias("shard"), bucket.alias("__b"), "__g")
    # At most 2**PROBE_BITS rows, so it may be broadcast: rows of each slice of the key space.
    rows = cut.groupBy("__b").agg(F.count("*").alias("__n"))
    cap = F.greatest(F.lit(64), F.least(F.lit(500_000), F.ceil(F.sum("__n").over(Window.partitionBy()) / (4 * shuffle_partitions(spark)))))
    pieces = rows.select("__b", F.ceil(F.col("__n") / cap).cast("long").alias("__pieces"))
    piece = F.pmod(F.shiftright(F.col("__g"), 8), F.col("__pieces"))
    cells = (
        cut.join(F.broadcast(pieces), "__b")
        .groupBy("shard", "__b", piece.alias("__s"))
        .agg(F.count("*").alias("__n"))
        .withColumn("__before", F.sum("__n").over(Window.partitionBy("shard").orderBy("__b", "__s").rowsBetween(Window.unboundedPreceding, -1)))
        .select("shard", "__b", "__s", F.coalesce("__before", F.lit(0)).alias("__before"))
    )
    cells = written(cells, "shard-cells")
    order = Window.partitionBy("shard", "__b", "__s").orderBy("__h", "__g")
    return (
        keyed.withColumns({"shard": shard, "__b": bucket})
        .join(F.broadcast(pieces), "__b")
        .withColumn("__s", piece)
        .withColumn("__at", F.row_number().over(order) - 1)
        .join(cells, ["shard", "__b", "__s"])
        .withColumns({"law": F.lit("bytes"), "slot": (F.col("__before") + F.col("__at")).cast("long"), "grown_shard": F.lit(None).cast("int")})
        .select(*[F.col(f"`{c}`") for c in keyed.columns if not c.startswith("__")], "law", "shard", "slot", "grown_shard")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, rows of a folder sorted by slot."""
    sharded.repartition("shard", F.shiftright("slot", 20)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op9_shards(spark, sf_dir: str) -> DataFrame:
    """All documents dealt to 8 shards of near equal bytes."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    slim = written(_keys(docs, "doc_id", "text").drop("text"), "shard-docs")
    bounds = splitters(slim, 8)
    out = _dealt(slim, slim, bounds)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
