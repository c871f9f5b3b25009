"""Bit records: round trips on generated values, short and empty data, nulls; levels against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidalframe.operators import levels as L
from tidalframe.operators import records as R


def test_bits_and_bytes_round_trip(spark):
    rng = random.Random(7)
    rows = [(bytes(rng.randrange(256) for _ in range(n)),) for n in (0, 1, 3, 4, 5, 8, 31, 200)] + [(None,)]
    df = spark.createDataFrame(rows, "x binary")
    for r in df.select("x", R.bits_of(F.col("x")).alias("bits"), R.packed(R.bits_of(F.col("x"))).alias("again")).collect():
        if r.x is None:
            assert r.bits is None and r.again is None
        else:
            assert r.bits == "".join(f"{b:08b}" for b in r.x) and r.again == r.x


@pytest.mark.parametrize("widths", [R.CONFIG_WIDTHS, R.COUNT_WIDTHS, R.UNIT_WIDTHS])
def test_escaped_numbers_round_trip(spark, widths):
    most = sum((1 << w) - 1 for w in widths if w)
    df = spark.range(min(most, 600) + 1).withColumn("bits", F.concat(F.lit("10"), R.escape_bits(F.col("id"), widths))).withColumn("data", R.packed(F.col("bits")))
    rows = df.select("id", F.length("bits").alias("n"), R.escape_number(F.col("data"), F.lit(2), widths).alias("v"), R.escape_number(F.expr("substring(data, 1, length(data) - 1)"), F.lit(2), widths).alias("cut")).collect()
    assert all(r.v.value == r.id and r.v.stop == r.n and r.cut is None for r in rows)


def test_records_of_no_bytes_and_null(spark):
    df = spark.createDataFrame([(b"",), (None,), (b"\xff",)], "x binary")
    x = F.col("x")
    out = df.select(R.descriptor(x)["err"].alias("a"), R.window_info(x, 49, 14)["err"].alias("b"), R.reorder_lengths(x, F.lit(True))["err"].alias("c"), R.downmix_fields(x).alias("d"), R.range_payload(x).alias("e"), R.spatial_fields(x)["err"].alias("f")).collect()
    assert out[0].a == out[2].a == "short"
    assert out[0].c == "short" and out[0].f == "short" and all(r.d is None and r.e is None for r in out)
    empty = R.replay_units(df, "x").collect()
    assert [r.err for r in empty] == ["short"] * 3 and all(r.units is None for r in empty)
    assert [r.err for r in R.file_fields(df, "x").collect()][0] == "short"


def test_replay_units_come_back(spark):
    units = [bytes([128 + k]) + bytes(range(k * 9)) for k in range(3)]
    df = spark.createDataFrame([(units[:n], bytes(k % 251 for k in range(size))) for n in range(4) for size in (0, 14, 15, 30, 31, 285)], "u array<binary>, c binary")
    out = R.replay_units(df.withColumn("r", R.replay_bytes(F.col("c"), F.size("u") % 2 == 0, F.col("u"))), "r").collect()
    assert all(r.err is None and r.config == r.c and [bytes(u) for u in r.units] == [bytes(u) for u in r.u] and r.fade == (len(r.u) % 2 == 0) for r in out)


def test_compression_bytes_fall_with_the_gain(spark):
    rows = spark.range(-4_000_000, 4_000_000, 9_973).select("id", R.compression_byte(F.col("id")).alias("b")).orderBy("id").collect()
    assert rows[0].b == 255 and rows[-1].b == 0
    finest = [r.b for r in rows if r.b < 255]
    assert all(a >= b for a, b in zip(finest, finest[1:], strict=False)) and all(v % 16 < 15 for v in finest)


def test_integer_steps_equal_big_integers(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(-8191, 8192), rng.randrange(-200, 120)) for _ in range(400)] + [(q, s) for q in (-8191, -1, 0, 1, 8, 8191) for s in (-300, -4, -1, 0, 3, 4, 8, 60, 300)]

    def root(v):
        r = round(v ** (1 / 3))
        while r**3 > v:
            r -= 1
        while (r + 1) ** 3 <= v:
            r += 1
        return r

    def exact(q, s):
        v = root(q**4 << 48) * L.QUARTERS[s % 4]
        up = s // 4 - 1
        v = v << up if up >= 0 else (v + (1 << -up - 1)) >> -up
        return int(math.copysign(1, q)) * min(v, L.LARGEST) if q else 0

    df = spark.createDataFrame(rows, "q int, s int")
    got = df.select("q", "s", L.integer_step(F.col("q"), F.col("s")).alias("v")).collect()
    assert [r.v for r in got] == [exact(r.q, r.s) for r in got]


def test_upmixing_keeps_power(spark):
    df = spark.range(-20, 21).select(L.upmixed((F.lit(0.6), F.lit(0.2)), (F.lit(0.2), F.lit(-0.6)), F.col("id").cast("int"), F.lit(5), F.col("id").cast("int")).alias("o")).select("o.*")
    for r in df.collect():  # the diffuse part is as strong as the direct one, and at right angles to it
        assert math.isclose(r.l_re**2 + r.l_im**2 + r.r_re**2 + r.r_im**2, 0.4, rel_tol=1e-9)


def test_limiter_borders_by_hand(spark):
    df = spark.createDataFrame([([4, 5, 8, 9, 16], [9], 2), ([4, 5, 8, 9, 16], [], 2), ([4, 16], [], 0), ([8, 9, 10, 32], [9, 10], 1)], "low array<int>, patches array<int>, s int")
    got = [r.b for r in df.select(L.limiter_borders(F.col("low"), F.col("patches"), F.col("s")).alias("b")).collect()]
    assert got == [[4, 5, 9, 16], [4, 5, 8, 16], [4, 16], [8, 9, 10, 32]]


def test_thresholds_of_silence_stay(spark):
    rows = [(1, t, 0, b, 4, e, e, th, 0.1) for t in range(3) for b, e, th in ((0, 0.0, 1e-3), (1, 0.0, 0.0))]
    df = spark.createDataFrame(rows, "stream long, t long, ch int, band int, width int, energy double, form double, threshold double, snr double")
    assert all(r.reduced == r.threshold for r in L.variable_thresholds(df, "stream", "t", 0.1).collect())
