"""Sharding and mixing: invariants, brute force, odd rows."""

import hashlib
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidalframe.llm import mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string"
ROWS = (
    [(i, f"w{i} " * (i % 9 + 1), f"s{i % 4}") for i in range(60)]
    + [(100 + i, "the same text", "hot") for i in range(40)]
    + [(200, None, "s1"), (201, "", None), (202, "  \t\n", "s2"), (203, "x " * 5000, "s3"), (204, "null source", None), (7, "w7 " * 8, "s3")]
)


def test_shards_are_near_equal_and_slots_gapless(spark):
    out = sharding.shard_documents(spark.createDataFrame(ROWS, SCHEMA), 4).collect()
    assert sorted(r.doc_id for r in out) == sorted(r[0] for r in ROWS)
    sizes = {}
    for r in out:
        sizes.setdefault(r.shard, []).append(r)
        raw = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    for rows in sizes.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))


def test_shards_of_even_rows_are_equal(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    sums = [r.n for r in sharding.shard_documents(df, 8).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sums) == 8 and max(sums) / min(sums) < 1.05


def test_one_text_over_all_rows_is_split_by_id(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    sums = [r.n for r in sharding.shard_documents(df, 8).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sums) == 8 and max(sums) / min(sums) < 1.1


def test_small_groups_of_copies_stay_together(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("group "), (F.col("id") / 3).cast("long")).alias("text"))
    out = sharding.shard_documents(df, 8)
    assert out.groupBy("text").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0


def test_shards_of_nothing_and_clashing_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sharding.shard_documents(empty, 4).count() == 0
    clash = spark.createDataFrame([(1, "a", 9, 9, "x")], "doc_id long, text string, Shard int, slot int, size string")
    r = sharding.shard_documents(clash, 4).first()
    assert (r.size, r.slot) == (2, 0) and len(r) == 8


def waterfilled(sizes: dict, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        target = {s: most * sizes[s] if s in full else left * w[s] / sum(w[f] for f in free) for s in order}
        over = {s for s in free if target[s] > most * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


def test_mix_meets_targets_exactly(spark):
    out = mixing.mix_sources(spark.createDataFrame(ROWS, SCHEMA)).collect()
    sizes, taken, target = {}, {}, {}
    for r in out:
        n = len(WORD.findall(r.text or ""))
        assert r.size == n and 0 <= r.taken <= 3 * n
        sizes[r.source] = sizes.get(r.source, 0) + n
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    want = waterfilled(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= 1
    assert {r.doc_id: r.source_size for r in out if r.source == "hot"} == {100 + i: 120 for i in range(40)}


def test_mix_takes_documents_in_key_order(spark):
    rows = [(i, "a b c", s) for i in range(50) for s in ("x",)] + [(100, "d " * 200, "y"), (101, "e " * 300, "z")]
    out = [r for r in mixing.mix_sources(spark.createDataFrame(rows, SCHEMA)).collect() if r.source == "x"]
    out.sort(key=lambda r: hashlib.md5(str(r.doc_id).encode()).hexdigest())
    taken = [r.taken for r in out]
    assert taken == sorted(taken, reverse=True)


def test_mix_reruns_agree_and_empty_is_empty(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    a = {(r.doc_id, r.source, r.taken) for r in mixing.mix_sources(df).collect()}
    b = {(r.doc_id, r.source, r.taken) for r in mixing.mix_sources(df.repartition(7)).collect()}
    assert a == b
    assert mixing.mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r.taken for r in mixing.mix_sources(spark.createDataFrame([(1, None, None), (2, "", "a")], SCHEMA)).collect()] == [0, 0]


def test_copies_spell_out_what_is_taken(spark):
    mixed = mixing.mix_sources(spark.createDataFrame(ROWS, SCHEMA))
    taken = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    got = {}
    for r in mixing.copies(mixed).collect():
        got[r.source] = got.get(r.source, 0) + len(WORD.findall(r.text or ""))
    assert got == {s: n for s, n in taken.items() if n}


def test_mix_equals_its_sql(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in mixing.op2_mix(spark, str(tmp_path)).where("doc_id <> 7").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == {tuple(r) for r in con.execute(f"SELECT * FROM ({mixing.OP2_SQL}) WHERE doc_id <> 7").fetchall()}
