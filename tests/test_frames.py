"""Framing: round trips, chunk sizes, garbage, corruption, seeded random bytes."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidalframe.functions import crc
from tidalframe.sources import frames as S
from tidalframe.streaming import stateful


def frame(payload: bytes, profile=1, rate=4, channels=2) -> bytes:
    n = len(payload) + 7
    head = (0xFFF1 << 40) + (profile << 38) + (rate << 34) + (channels << 30) + (n << 13) + (0x7FF << 2)
    return head.to_bytes(7, "big") + payload


def test_writer_and_parser_agree(spark):
    df = spark.createDataFrame([(bytearray(b"abc"),), (bytearray(b""),)], "p binary")
    made = df.withColumn("f", S.framed(F.col("p"), F.lit(1), F.lit(4), F.lit(2))).withColumn("h", S.header(F.col("f")))
    for r in made.collect():
        assert bytes(r.f) == frame(bytes(r.p)) and r.h.err is None
        assert (r.h.profile, r.h.rate_index, r.h.channels, r.h.frame_length, r.h.fullness, r.h.blocks) == (1, 4, 2, len(r.p) + 7, 0x7FF, 1)


def test_too_long_a_payload_is_null(spark):
    df = spark.createDataFrame([(bytearray(8185),)], "p binary")
    assert df.select(S.framed(F.col("p"), F.lit(1), F.lit(4), F.lit(2)).alias("f")).first().f is None


@pytest.mark.parametrize("data,err", [(b"\xff\xf1", "short"), (b"\x00" * 9, "sync"), (b"\xff\xf7" + b"\x00" * 7, "layer"), (frame(b"x", rate=13), "rate"), (frame(b"")[:3] + b"\x80\x00\x1f\xfc", "length")])
def test_header_errors(spark, data, err):
    assert spark.createDataFrame([(bytearray(data),)], "d binary").select(S.header(F.col("d")).alias("h")).first().h.err == err


def pushed(scanner, data, rng, most):
    """All that the scanner finds in ``data``, given in random pieces of up to ``most`` bytes."""
    got, at = [], 0
    while at < len(data):
        n = rng.randint(1, most)
        got += scanner.push(data[at : at + n])
        at += n
    return got


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=60).map(lambda p: p.replace(b"\xff", b"\xfe")), min_size=1, max_size=20), st.integers(1, 300), st.integers(0, 2**32))
def test_any_chunking_gives_the_same_frames(payloads, most, seed):
    rng = random.Random(seed)
    data = b"".join(rng.choice([b"", b"noise", b"\x00\xff"]) + frame(p) for p in payloads)
    got = pushed(S.Scanner(), data, rng, most)
    assert [f[-1] for f in got] == payloads and [f[0] for f in got] == list(range(len(payloads)))
    loas = lambda p: ((0x2B7 << 13) + len(p)).to_bytes(3, "big") + p
    plain = [p.replace(b"\x56", b"\x55") for p in payloads]
    got = pushed(S.LoasScanner(), b"".join(rng.choice([b"", b"noise", b"\x00\x57"]) + loas(p) for p in plain), rng, most)
    assert [f[-1] for f in got] == plain


def test_a_false_header_gives_way_to_a_whole_frame():
    false = frame(bytes(4000))[:7]
    scanner = S.Scanner()
    assert [f[-1] for f in scanner.push(false + frame(b"real"))] == [b"real"] and scanner.discarded == 7


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"\xff", b"\xf1", b"\xf0", b"\x56", b"\xe0"]) | st.binary(min_size=1, max_size=9), max_size=60), st.integers(1, 40), st.integers(0, 99))
def test_random_bytes_do_no_harm(parts, most, seed):
    data = b"".join(parts)
    for scanner in (S.Scanner(), S.LoasScanner()):
        pushed(scanner, data, random.Random(seed), most)
        assert scanner.offset + len(scanner.held) == len(data)


def blocks_of(spark, payloads):
    df = spark.createDataFrame([([bytearray(p) for p in payloads],)], "x array<binary>")
    made = df.select(S.block_frames(F.col("x"), 1, F.lit(4), F.lit(2)).alias("f")).first().f
    return None if made is None else bytes(made)


def read_blocks(spark, data):
    return spark.createDataFrame([(bytearray(data),)], "f binary").select(F.inline(S.raw_blocks(F.col("f")))).collect()


def test_blocks_go_there_and_back(spark):
    for payloads in ([b"only"], [b"a", b""], [b"one", b"two" * 50, b"", b"four"]):
        data = blocks_of(spark, payloads)
        got = read_blocks(spark, data)
        assert [bytes(r.payload) for r in got] == payloads and all(r.err is None for r in got)
        assert [r.crc_ok for r in got] == ([None] if len(payloads) == 1 else [True] * len(payloads))
        head = spark.createDataFrame([(bytearray(data),)], "f binary").select(S.header(F.col("f")).alias("h")).first().h
        assert (head.blocks, head.frame_length, head.checked, head.err) == (len(payloads), len(data), True, None)
        start = 7 + 2 * (len(payloads) - 1)
        assert int.from_bytes(data[start : start + 2], "big") == crc.crc_bits(data[:start], 0, 8 * start, *crc.CRC16)
    assert blocks_of(spark, [b"x" * 4000, b"y" * 4500]) is None


def test_broken_block_frames_say_why(spark):
    data = bytearray(blocks_of(spark, [b"one", b"two"]))
    assert [r.err for r in read_blocks(spark, data[:9])] == ["short"]
    bad = bytearray(data)
    bad[7:9] = b"\x00\x01"
    assert [r.err for r in read_blocks(spark, bad)] == ["position"]
    bad = bytearray(data)
    bad[1] |= 1
    assert [r.err for r in read_blocks(spark, bad)] == ["unprotected"]
    data[12] ^= 1
    assert [r.crc_ok for r in read_blocks(spark, data)] == [False, True]


def test_files_are_read_by_spark(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"xx" + frame(b"one") + frame(b"two"))
    (tmp_path / "b.bin").write_bytes(b"")
    got = S.read_frames(spark, str(tmp_path)).orderBy("seq").collect()
    assert [bytes(r.payload) for r in got] == [b"one", b"two"]


def test_loas_round_trip(spark):
    df = spark.createDataFrame([(bytearray(b"hello"),)], "p binary").withColumn("f", S.loas_framed(F.col("p")))
    r = df.select("f", S.loas_header(F.col("f")).alias("h")).first()
    assert bytes(r.f)[:3] == ((0x2B7 << 13) + 5).to_bytes(3, "big") and (r.h.ok, r.h.length) == (True, 5)


def _streamed(spark, tmp_path, batches, schema, build):
    source, i = tmp_path / "in", 0
    source.mkdir()
    rows = []
    stream = spark.readStream.schema(schema).parquet(str(source))
    query = build(stream).writeStream.format("memory").queryName("t" + tmp_path.name.replace("-", "_")).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for batch in batches:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(source))
            query.processAllAvailable()
            i += 1
        rows = spark.table("t" + tmp_path.name.replace("-", "_")).collect()
    finally:
        query.stop()
    return rows


def test_streamed_frames_equal_the_batch(spark, tmp_path):
    data = b"\x00" + b"".join(frame(bytes([i] * i)) for i in range(12))
    cuts = [0, 5, 6, 50, 51, len(data)]
    pieces = [(1, k, bytearray(data[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    rows = _streamed(spark, tmp_path, [pieces[:2], pieces[2:3], pieces[3:]], "stream long, seq long, chunk binary", stateful.stream_frames)
    assert [bytes(r.payload) for r in sorted(rows, key=lambda r: r.seq)] == [bytes([i] * i) for i in range(12)]


def test_streamed_reservoir_equals_the_batch(spark, tmp_path):
    from tidalframe.operators import order

    rows = [(u, s, (u * 7 + s * 13) % 300) for u in (1, 2) for s in range(9)]
    batches = [[r for r in rows if r[1] < 4], [r for r in rows if r[1] >= 4]]
    schema = "unit long, sub long, bits long"
    got = _streamed(spark, tmp_path, batches, schema, lambda s: stateful.stream_reservoir(s, 150, 400))
    want = order.reservoir(spark.createDataFrame(rows, schema), 150, 400).collect()
    assert {(r.unit, r.sub, r.fullness) for r in got} == {(r.unit, r.sub, r.fullness) for r in want}


def test_block_frames_are_python_values_a_run_at_a_time():
    import pyarrow as pa

    sizes, values, more = [], pa.array(range(3 * S.RUN + 1)), pa.array([], pa.int64())

    def doubled(rows):
        sizes.append(len(rows))
        return [2 * v for v in rows]

    out = list(S._runs(doubled, pa.int64(), iter([(values,), (more,), (values[:2],)])))
    assert sizes == [S.RUN] * 3 + [1, 2] and pa.concat_arrays(out).to_pylist() == [2 * v for v in [*range(3 * S.RUN + 1), 0, 1]]
