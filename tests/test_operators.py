"""Operators on rows worked out by hand, and against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidalframe.functions import crc, numeric
from tidalframe.operators import adaptive, bands, control, gain, order, quant, stereo, transform


def signal(spark, values, stream=1):
    return spark.createDataFrame([(stream, t, v) for t, v in enumerate(values)], "stream long, t long, v double")


def column(df, name):
    return [r[name] for r in df.orderBy("t").collect()]


@pytest.mark.parametrize("attack,release,seed", [(3, 11, 1), (8, 40, 2), (1, 1, 3)])
def test_limiter_looks_ahead_and_keeps_to_one(spark, attack, release, seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal(400) * np.repeat(rng.choice([0.2, 0.9, 2.5], 40), 10)
    df = spark.createDataFrame([(1, t, float(v)) for t, v in enumerate(x)] + [(2, t, float(v) * 0.1) for t, v in enumerate(x)], "stream long, t long, v double")
    rows = order.limited(df, attack, release).orderBy("stream", "t").collect()
    gain, out = (np.array([r[c] for r in rows if r.stream == 1]) for c in ("gain", "limited"))
    late = np.concatenate([np.zeros(attack), x])[: len(x)]
    assert np.allclose(out, late * gain) and np.abs(out).max() <= 1 + 1e-9  # the gain alone keeps to one: nothing is clipped
    peaks = np.array([max(1.0, np.abs(x[max(0, t - attack) : t + 1]).max()) for t in range(len(x))])
    assert (gain <= np.maximum(1 / peaks, np.append(1.0, gain[:-1])) + 1e-9).all() and gain.min() < 0.6 < 0.9 < gain[-1] + 0.5
    calm = np.abs(x).max() * 0.1 <= 1
    assert not calm or all(r.gain == 1.0 for r in rows if r.stream == 2)
    for at in np.flatnonzero(np.diff(peaks) > 0.5) + 1:  # by the time a new peak comes out, nine tenths of the way are done
        if at + attack < len(gain):
            assert gain[at + attack] <= 1 / peaks[at] + 0.11 * (1 - 1 / peaks[at])


def test_limiter_holds_an_impulse_back(spark):
    x = np.zeros(50)
    x[7] = -0.625
    out = column(order.limited(signal(spark, x.tolist()), 12, 33), "limited")
    assert out[19] == -0.625 and sum(map(abs, out)) == 0.625


def test_crcs_of_many_values_equal_bit_by_bit_ones():
    rng = random.Random(8)
    values = [rng.randbytes(rng.choice([0, 1, 5, 300])) for _ in range(400)] + [rng.randbytes(3000)]
    for kind in (crc.CRC16, crc.CRC8):
        got = crc.crcs(values, *kind)
        assert all(int(g) == crc.crc_bits(v, 0, 8 * len(v), *kind) for g, v in list(zip(got, values))[::7] + [(got[-1], values[-1])])
        assert [int(g) for g in crc.crcs(values[:5], *kind)] == [int(g) for g in got[:5]] and len(crc.crcs([], *kind)) == 0


def test_tracked_range_by_hand(spark):
    """Above the range, below it, inside, and far above; a first row of 100 gives 100 -+ 100/12."""
    for v in (150.0, 50.0, 97.0, 600.0):
        got = adaptive.tracked_range(signal(spark, [100.0, v])).orderBy("t").collect()
        low, high = 100 - 100 / 12, 100 + 100 / 12
        if v > high:
            low, high = low + 0.3 * (v - high), v
        elif v < low:
            low, high = low - 0.14 * (low - v), high - 0.07 * (low - v)
        else:
            low, high = low + 0.3 * (v - low), high - 0.07 * (high - v)
        if high - low < v / 6:
            below, above = max(v - low, 0), max(high - v, 0)
            low, high = max(v - below / (below + above) * v / 6, 0), v + above / (below + above) * v / 6
        assert (got[0].low, got[0].high) == pytest.approx((100 - 100 / 12, 100 + 100 / 12)) and (got[1].low, got[1].high) == pytest.approx((low, high))


def test_sections_equal_all_covers(spark):
    rng = random.Random(9)
    rows = []
    for key in range(30):
        rows.append((key, [[None if rng.random() < 0.2 else float(rng.randint(0, 9)), float(rng.randint(0, 9)), float(rng.randint(0, 6))] for _ in range(rng.randint(1, 6))]))
    got = {}
    for r in control.chosen_sections(spark.createDataFrame(rows, "key long, x array<array<double>>"), "key", 3).collect():
        got.setdefault(r.key, []).append(r)
    for key, x in rows:
        parts = sorted(got[key])
        assert [p.start for p in parts] == [0, *[p.stop for p in parts[:-1]]] and parts[-1].stop == len(x)
        best = float("inf")
        for cuts in range(1 << (len(x) - 1)):
            borders = [0, *[i + 1 for i in range(len(x) - 1) if cuts >> i & 1], len(x)]
            best = min(best, sum(9 + min(sum(1e9 if row[c] is None else row[c] for row in x[a:b]) for c in range(3)) for a, b in zip(borders, borders[1:])))
        assert sum(p.bits for p in parts) == best


def test_ordered_scan_keeps_streams_apart(spark):
    both = signal(spark, [3.0, 0.1], 1).union(signal(spark, [0.2, 0.3], 2))
    out = order.block_states(both.withColumn("ratio", F.col("v") * 10), 10.0)
    assert [r.state for r in out.orderBy("stream", "t").collect()] == ["start", "short", "long", "long"]


def test_block_states_go_through_all_four(spark):
    df = signal(spark, [0.0, 11.0, 0.0, 12.0, 0.0, 0.0]).withColumnRenamed("v", "ratio")
    assert column(order.block_states(df, 10.0), "state") == ["long", "start", "short", "short", "stop", "long"]


@pytest.mark.parametrize("seed", range(3))
def test_reservoir_closed_form_equals_the_recurrence(spark, seed):
    rng = random.Random(seed)
    bits = [rng.randint(0, 300) for _ in range(60)]
    df = spark.createDataFrame([(1, i, b) for i, b in enumerate(bits)], "unit long, sub long, bits long")
    want, full = [], 0
    for b in bits:
        full = min(400, full + 150 - b)
        want.append(full)
    assert [r.fullness for r in order.reservoir(df, 150, 400).orderBy("sub").collect()] == want


def test_concealment_fades_and_ends(spark):
    out = column(order.concealed(signal(spark, [1.0] + [None] * 8 + [2.0]), 0.5, 6), "v")
    assert out[:7] == [1.0, 0.5, 0.25, 0.125, 0.0625, 0.03125, 0.015625] and out[7:] == [0.0, 0.0, 2.0]


def test_concealment_without_a_good_row_is_silence(spark):
    assert column(order.concealed(signal(spark, [None, None, 1.0]), 0.5, 6), "v") == [0.0, 0.0, 1.0]


def test_gain_holds_outside_and_is_linear_inside(spark):
    points = spark.createDataFrame([(1, t) for t in (-5, 0, 5, 10, 99)] + [(2, 3)], "stream long, t long")
    nodes = spark.createDataFrame([(1, 0, 1.0, 0.0), (1, 10, 3.0, 0.0)], "stream long, t long, gain_db double, slope double")
    got = {(r.stream, r.t): r.gain_db for r in gain.gain_at(points, nodes).collect()}
    assert got == {(1, -5): 1.0, (1, 0): 1.0, (1, 5): 2.0, (1, 10): 3.0, (1, 99): 3.0, (2, 3): 0.0}
    spline = {r.t: r.gain_db for r in gain.gain_at(points.where("stream = 1"), nodes, True).collect()}
    assert spline[5] == pytest.approx(2.0) and spline[0] == 1.0


def test_mid_side_and_back(spark):
    pairs = spark.createDataFrame([(0, 0, 3.0, 1.0)], "frame long, line int, a double, b double")
    once = stereo.mid_side(pairs, F.lit(True), 1 / math.sqrt(2))
    r = stereo.mid_side(once.select("frame", "line", F.col("l").alias("a"), F.col("r").alias("b")), F.lit(True), 1 / math.sqrt(2)).first()
    assert (r.l, r.r) == (pytest.approx(3.0), pytest.approx(1.0))


def test_dequantize_and_fixed_point(spark):
    row = spark.range(1).select(
        numeric.dequantized(F.lit(-8), F.lit(4)).alias("d"),
        numeric.to_q31(F.lit(2.0)).alias("top"),
        numeric.to_q31(F.lit(float("nan"))).alias("nan"),
        numeric.float_to_pcm16(F.lit(-1.5 / 32768)).alias("half"),
        numeric.q31_to_pcm16(F.lit(-1)).alias("floor"),
        numeric.mul_q31(F.lit(-(2**31)), F.lit(-(2**31))).alias("sat"),
        numeric.leading_zeros(F.lit(1)).alias("lz"),
    ).first()
    assert (row.d, row.top, row.nan, row.half, row.floor, row.sat, row.lz) == (pytest.approx(-32.0), 2**31 - 1, 0, -2, -1, 2**31 - 1, 31)


def test_crc_table_equals_bits(spark):
    rng = random.Random(5)
    blobs = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 7, 100)] + [None]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in enumerate(blobs)], "i int, b binary")
    for spec in (crc.CRC16, crc.CRC8):
        got = {r.i: r.c for r in df.select("i", crc.crc_udf(*spec)("b").alias("c")).collect()}
        for i, b in enumerate(blobs):
            assert got[i] == (None if b is None else crc.crc_bits(b, 0, 8 * len(b), *spec))


def test_crc_of_bit_ranges_with_padding():
    assert crc.crc_bits(b"\xa0", 0, 12, *crc.CRC8) == crc.crc_bits(b"\xa0\x00", 0, 12, *crc.CRC8)


def test_quantiser_meets_its_noise_bound(spark):
    x = [0.5, -0.25, 0.125, 0.8]
    df = spark.createDataFrame([(x, 1e-3), ([0.0] * 4, 1e-3)], "x array<double>, allowed double")
    loud, silent = quant.quantised_bands(df).collect()
    step = 2 ** (0.25 * loud.scale)
    noise = sum((abs(v) - abs(q) ** (4 / 3) * step) ** 2 for v, q in zip(x, loud.levels))
    assert noise <= 1e-3 / 1.25 and silent.scale == 0 and silent.levels == [0] * 4


def test_sections_equal_brute_force(spark):
    from itertools import product

    costs = [[3, 1, 4], [1, 5, 9], [2, 6, 5], [3, 5, 8]]
    best = min(sum(c[k] for c, k in zip(costs, ways)) + 3 * (1 + sum(a != b for a, b in zip(ways, ways[1:]))) for ways in product(range(3), repeat=4))
    df = spark.createDataFrame([(1, i, *c) for i, c in enumerate(costs)], "unit long, sub long, a long, b long, c long")
    assert quant.section_costs(df, ["a", "b", "c"], 3).first().total == best


def test_transforms_invert(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal(16)
    row = spark.createDataFrame([(x.tolist(),)], "x array<double>").withColumn("y", transform.dct4(F.col("x"), 16)).withColumn("z", transform.dct4(F.col("y"), 16)).first()
    assert np.allclose(np.array(row.z) * 2 / 16, x)


def test_grouping_lengths(spark):
    df = spark.createDataFrame([(1, 0b1111111), (2, 0), (3, 0b1010000)], "k int, b int")
    got = {r.k: r.lengths for r in bands.grouping_lengths(df, "k", F.col("b")).collect()}
    assert got == {1: "8", 2: ",".join("1" * 8), 3: "2,2,1,1,1,1"}


def test_losses_round_half_down(spark):
    df = spark.createDataFrame([(0, 10), (1490, 10), (1510, 10)], "distance long, bits long")
    # one unit is 1000 bits here: 10 -> 0, 1500 -> half, down to 1, less the one found, 1520 -> 2 less one
    assert [r.lost for r in order.losses(df, 1, 1, 1000).orderBy("distance").collect()] == [0, 0, 1]


def test_overlap_add_flushes_the_tail_once(spark):
    df = spark.createDataFrame([(0, 0, [1.0, 2.0, 3.0, 4.0]), (0, 1, [10.0, 20.0, 30.0, 40.0])], "ch int, frame long, x array<double>")
    got = [r.v for r in order.overlap_added(df).orderBy("frame", "line").collect()]
    assert got == [1.0, 2.0, 13.0, 24.0, 30.0, 40.0]
