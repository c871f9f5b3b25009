"""Queries on spectra: bands, stereo, quantisation, transforms and scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import bands as B
from ..operators import quant as Q
from ..operators import stereo as S
from ..operators import transform as X
from .views import BORDERS, banded, duck, spectra, table, vectors

LINES = 64


def _measures(spark, d):
    return B.band_measures(banded(spectra(spark, d)))


def band_energy(spark, d):
    return _measures(spark, d).select("frame", "ch", "band", F.round("energy", 6).alias("energy"), F.round("form_factor", 6).alias("form_factor"))


def band_tonality(spark, d):
    return _measures(spark, d).select("frame", "ch", "band", F.round("tonality", 6).alias("tonality"))


def masking_threshold(spark, d):
    return B.masking(_measures(spark, d)).select("frame", "ch", "band", F.round("threshold", 8).alias("threshold"))


def perceptual_entropy(spark, d):
    return B.perceptual_entropy(B.masking(_measures(spark, d))).select("frame", "ch", F.round("entropy", 4).alias("entropy"))


def transient_ratio(spark, d):
    return B.transient_ratio(B.chunk_energies(spectra(spark, d))).select("frame", "ch", F.round("ratio", 6).alias("ratio"))


def window_groups(spark, d):
    return B.similar_runs(B.chunk_energies(spectra(spark, d))).select("frame", "ch", "grp", "first", "length")


def grouping_lengths(spark, d):
    return B.grouping_lengths(table(spark, d, "part").select("p_partkey"), "p_partkey", (F.col("p_partkey") * 37) % 128)


def band_gain(spark, d):
    return B.band_gains(_measures(spark, d), F.lit(0.02)).select("frame", "ch", "band", F.round("gain", 6).alias("gain"))


def low_deemphasis(spark, d):
    return B.peaks_deemphasis(spectra(spark, d), LINES, 4).select("frame", "ch", "chunk", F.round("gain", 6).alias("gain"))


MEASURES = (
    duck("spectra", "bands")
    + """,
banded AS (SELECT s.*, b.band, v * v + 1e-30 AS p FROM spectra s JOIN bands b ON s.line >= b.start AND s.line < b.stop),
measures AS (SELECT frame, ch, band, count(*) AS width, sum(p) AS energy, sum(sqrt(abs(v))) AS form_factor,
  1 - greatest(0.0, least(1.0, exp(avg(ln(p))) / greatest(avg(p), 1e-30))) AS tonality FROM banded GROUP BY frame, ch, band),
spread AS (SELECT *, energy + coalesce(lag(energy) OVER w, 0) * 0.15 + coalesce(lead(energy) OVER w, 0) * 0.05 AS spread,
  width * 1e-9 * pow(1 + band * 0.08, 2) AS least_t FROM measures WINDOW w AS (PARTITION BY frame, ch ORDER BY band)),
masked AS (SELECT *, least(greatest(spread * (0.16 - 0.13 * tonality), least_t), greatest(energy, least_t)) AS threshold FROM spread)
"""
)
CHUNKS = duck("spectra") + ",\nchunks AS (SELECT frame, ch, line // 8 AS chunk, sum(v * v) AS energy FROM spectra GROUP BY frame, ch, line // 8)\n"


# ------------------------------------------------------------------ stereo
def _pairs(spark, d):
    return S.paired(spectra(spark, d))


def _used():
    return (F.col("frame") + F.expr("line div 8")) % 3 == 0


def _rounded(df):
    return df.select("frame", "line", F.round("l", 9).alias("l"), F.round("r", 9).alias("r"))


def mid_side(spark, d):
    return _rounded(S.mid_side(_pairs(spark, d), _used(), 1 / math.sqrt(2)))


def mid_side_plain(spark, d):
    return _rounded(S.mid_side(_pairs(spark, d), _used(), 1.0))


def intensity(spark, d):
    scale = N.intensity_scale(F.col("frame") % 16, F.col("frame") % 2 == 1)
    return _rounded(S.intensity(_pairs(spark, d), F.col("line") >= 32, scale))


def predicted_side(spark, d):
    return _rounded(S.predicted_side(_pairs(spark, d), 0.3, -0.2))


def stereo_cues(spark, d):
    return S.cues(_pairs(spark, d), 8, LINES)


PAIRS = (
    duck("spectra")
    + """,
pairs AS (SELECT frame, line, coalesce(max(CASE WHEN ch = 0 THEN v END), 0) AS a, coalesce(max(CASE WHEN ch = 1 THEN v END), 0) AS b,
  (frame + line // 8) % 3 = 0 AS used FROM spectra GROUP BY frame, line)
"""
)


def _ms_sql(scale: str) -> str:
    return PAIRS + f"SELECT frame, line, round(CASE WHEN used THEN (a + b) * {scale} ELSE a END, 9) AS l, round(CASE WHEN used THEN (a - b) * {scale} ELSE b END, 9) AS r FROM pairs"


# ------------------------------------------------------------------ layouts
#: Gains of a downmix of four sources to two targets, and a wider layout.
MIX = (("error", "l", 0.7), ("error", "r", 0.7), ("click", "l", 1.0), ("view", "r", 1.0), ("purchase", "l", 0.5), ("purchase", "r", -0.5))
LAYOUT = ("view", "click", "purchase", "error", "signup", "rear")


def _inline(spark, rows, names):
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names, strict=True)]) for r in rows])))


def _hourly(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("t"), F.col("event_type").alias("src")).agg(F.sum("value").alias("v"))


def downmix(spark, d):
    out = S.matrix_mix(_hourly(spark, d), _inline(spark, MIX, ("src", "dst", "gain")))
    return out.select("t", "dst", F.round("v", 4).alias("v"))


def channel_extend(spark, d):
    layout = _inline(spark, [(i, x) for i, x in enumerate(LAYOUT)], ("ord", "label"))
    out = S.extended(_hourly(spark, d).withColumnRenamed("src", "label"), layout)
    return out.select("t", "ord", "label", F.round("v", 4).alias("v"), "padded")


def interleave(spark, d):
    frames = spectra(spark, d).groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("line", "ch", "v"))).alias("x"))
    return frames.select("frame", F.posexplode(F.transform("x", lambda s: s["v"])).alias("pos", "v"))


HOURLY = "hourly AS (SELECT date_trunc('hour', ts) AS t, event_type AS src, sum(value) AS v FROM events GROUP BY 1, 2)"


# ------------------------------------------------------------------ numbers
def _coded(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", ((F.col("l_partkey") % 401) - 200).alias("q"), ((F.col("l_suppkey") % 61) - 30).alias("s"))


def dequantize(spark, d):
    return _coded(spark, d).groupBy("q", "s").agg(F.count("*").alias("n")).select("q", "s", "n", F.round(N.dequantized(F.col("q"), F.col("s")), 4).alias("x"))


def fixed_point(spark, d):
    x = F.col("v") * 1.7
    rows = spectra(spark, d).select("frame", "ch", "line", N.to_q31(x).alias("q31"), N.float_to_pcm16(x).alias("pcm"))
    product = N.mul_q31(F.col("q31"), F.lit(1518500250))
    shifted = N.shifted_q31(F.col("q31"), F.col("line") % 9 - 4)
    return rows.select("frame", "ch", "line", "q31", "pcm", product.alias("scaled"), shifted.alias("shifted"), N.q31_to_pcm16(F.col("q31")).alias("pcm_floor"))


def headroom(spark, d):
    q = N.to_q31(F.col("v"))
    rows = spectra(spark, d).groupBy("frame", "ch").agg(F.bit_or(F.when(q < 0, -q - 1).otherwise(q)).alias("m"))
    return rows.select("frame", "ch", F.greatest(F.lit(0), N.leading_zeros(F.col("m")) - 1).cast("int").alias("headroom"))


def loudness_gain(spark, d):
    p = table(spark, d, "part")
    db = -24.0 - F.col("p_size") * -0.5
    return p.select("p_partkey", F.round(db, 4).alias("gain_db"), F.round(F.col("p_retailprice") * N.gain(db) + 1e-9, 4).alias("scaled"), F.round(F.pow(F.lit(2.0), F.col("p_size") / 4.0), 4).alias("noise_gain"))


def mixed_radix(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 81).alias("w"))
    return p.select("p_partkey", *[(F.expr(f"w div {3**k}") % 3 - 1).cast("int").alias(f"d{k}") for k in range(4)])


def rate_index(spark, d):
    rates = [96000, 48000, 32000, 16000, 8000]
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 7919 % 100000).alias("rate"))
    index = F.lit(len(rates))
    for i in reversed(range(len(rates))):
        index = F.when(F.col("rate") >= rates[i], i).otherwise(index)
    return p.select("p_partkey", "rate", index.cast("int").alias("rate_index"))


# ------------------------------------------------------------------ quantisation, transforms
def quantize_band(spark, d):
    s = banded(spectra(spark, d)).groupBy("frame", "ch", "band").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "v"))), lambda x: x["v"]).alias("x"))
    t = B.masking(_measures(spark, d)).select("frame", "ch", "band", F.col("threshold").alias("allowed"))
    out = Q.quantised_bands(s.join(t, ["frame", "ch", "band"]))
    return out.select("frame", "ch", "band", "scale", F.aggregate("levels", F.lit(0).cast("long"), lambda a, v: a + F.abs(v)).alias("magnitude"))


def imdct(spark, d):
    out = vectors(spark, d).select("frame", "ch", F.posexplode(X.imdct(F.col("x"), LINES)).alias("n", "v"))
    return out.select("frame", "ch", "n", F.round("v", 6).alias("v"))


def dct4(spark, d):
    out = vectors(spark, d).select("frame", "ch", F.posexplode(X.dct4(F.col("x"), LINES)).alias("n", "v"))
    return out.select("frame", "ch", "n", F.round("v", 6).alias("v"))


def sine_window(spark, d):
    return X.sine_window(spark, 256).select("i", F.round("w", 9).alias("w"))


def kaiser_window(spark, d):
    return X.kaiser_window(spark, 64, 4.0).select("i", F.round("w", 9).alias("w"))


_THRESHOLD_SQL = MEASURES + f""",
lines AS (SELECT b.frame, b.ch, b.band, b.v, greatest(m.threshold / 1.25, 1e-20) AS allowed FROM banded b JOIN masked m USING (frame, ch, band)),
tried AS (SELECT frame, ch, band, s.scale, min(allowed) AS allowed, sum(pow(abs(v) - pow(least(round(pow(abs(v) / pow(2.0, 0.25 * s.scale), 0.75)), 8191), 4.0 / 3.0) * pow(2.0, 0.25 * s.scale), 2)) AS noise,
  max(abs(v)) AS top FROM lines, (SELECT unnest(range({Q.LEAST_SCALE}, {Q.MOST_SCALE + 1})) AS scale) s GROUP BY frame, ch, band, s.scale),
fit AS (SELECT *, noise <= allowed AS ok FROM tried),
firsts AS (SELECT frame, ch, band, max(top) AS top, min(CASE WHEN ok THEN scale END) AS f FROM fit GROUP BY frame, ch, band),
ends AS (SELECT x.frame, x.ch, x.band, max(x.top) AS top, max(x.f) AS f, min(CASE WHEN NOT ok AND scale > x.f THEN scale END) AS e FROM firsts x JOIN fit USING (frame, ch, band) GROUP BY x.frame, x.ch, x.band),
chosen AS (SELECT frame, ch, band, CAST(CASE WHEN top <= 1e-20 THEN 0 WHEN f IS NULL THEN {Q.LEAST_SCALE} WHEN e IS NULL THEN {Q.MOST_SCALE} ELSE e - 1 END AS INTEGER) AS scale FROM ends)
SELECT c.frame, c.ch, c.band, c.scale, CAST(sum(CASE WHEN abs(v) <= 1e-20 THEN 0 ELSE least(round(pow(abs(v) / pow(2.0, 0.25 * c.scale), 0.75)), 8191) END) AS BIGINT) AS magnitude
FROM chosen c JOIN lines l USING (frame, ch, band) GROUP BY c.frame, c.ch, c.band, c.scale"""

QUERIES = {
    "band_energy": (band_energy, MEASURES + "SELECT frame, ch, band, round(energy, 6) AS energy, round(form_factor, 6) AS form_factor FROM measures"),
    "band_tonality": (band_tonality, MEASURES + "SELECT frame, ch, band, round(tonality, 6) AS tonality FROM measures"),
    "masking_threshold": (masking_threshold, MEASURES + "SELECT frame, ch, band, round(threshold, 8) AS threshold FROM masked"),
    "perceptual_entropy": (perceptual_entropy, MEASURES + "SELECT frame, ch, round(sum(CASE WHEN energy > threshold THEN width * log2(energy / threshold) ELSE 0 END), 4) AS entropy FROM masked GROUP BY frame, ch"),
    "transient_ratio": (transient_ratio, CHUNKS + "SELECT frame, ch, round(CASE WHEN avg(energy) <= 1.1920929e-07 THEN 0 ELSE max(energy) / avg(energy) END, 6) AS ratio FROM chunks GROUP BY frame, ch"),
    "window_groups": (
        window_groups,
        CHUNKS
        + """, marked AS (SELECT *, CASE WHEN lag(energy) OVER w IS NULL OR greatest(energy, lag(energy) OVER w) <= 1e-20
  OR greatest(energy, lag(energy) OVER w) / greatest(least(energy, lag(energy) OVER w), 1e-20) <= 4 THEN 0 ELSE 1 END AS new FROM chunks WINDOW w AS (PARTITION BY frame, ch ORDER BY chunk)),
g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY frame, ch ORDER BY chunk) AS BIGINT) AS grp FROM marked)
SELECT frame, ch, grp, CAST(min(chunk) AS BIGINT) AS first, count(*) AS length FROM g GROUP BY frame, ch, grp""",
    ),
    "grouping_lengths": (
        grouping_lengths,
        """WITH w AS (SELECT p_partkey, i, CASE WHEN i = 0 THEN 0 ELSE 1 - ((((p_partkey * 37) % 128) >> (7 - i)) & 1) END AS new FROM part, (SELECT unnest(range(0, 8)) AS i)),
g AS (SELECT *, sum(new) OVER (PARTITION BY p_partkey ORDER BY i) AS g FROM w), r AS (SELECT p_partkey, g, count(*) AS n FROM g GROUP BY p_partkey, g)
SELECT p_partkey, string_agg(CAST(n AS VARCHAR), ',' ORDER BY g) AS lengths FROM r GROUP BY p_partkey""",
    ),
    "band_gain": (band_gain, MEASURES + "SELECT frame, ch, band, round(least(sqrt(0.02 / greatest(energy / width, 1e-30)), 1e4), 6) AS gain FROM measures"),
    "low_deemphasis": (
        low_deemphasis,
        duck("spectra")
        + """, c AS (SELECT frame, ch, CAST(line // 4 AS BIGINT) AS chunk, sum(v * v) AS e FROM spectra WHERE line < 16 GROUP BY 1, 2, 3)
SELECT frame, ch, chunk, round(greatest(0.1, max(sqrt(e / greatest(p, 1e-30))) OVER (PARTITION BY frame, ch ORDER BY chunk)), 6) AS gain FROM (SELECT *, max(e) OVER (PARTITION BY frame, ch) AS p FROM c)""",
    ),
    "mid_side": (mid_side, _ms_sql("(1 / sqrt(2.0))")),
    "mid_side_plain": (mid_side_plain, _ms_sql("1.0")),
    "intensity": (intensity, PAIRS + "SELECT frame, line, round(a, 9) AS l, round(CASE WHEN line >= 32 THEN a * CASE WHEN frame % 2 = 1 THEN -1 ELSE 1 END * pow(2.0, -0.25 * (frame % 16)) ELSE b END, 9) AS r FROM pairs"),
    "predicted_side": (
        predicted_side,
        PAIRS
        + """, m AS (SELECT *, (a + b) * 0.5 AS m FROM pairs),
n AS (SELECT *, coalesce(lag(m) OVER (PARTITION BY frame ORDER BY line), (SELECT p.m FROM m p WHERE p.frame = m.frame - 1 AND p.line = 63), 0) AS before, coalesce(lead(m) OVER (PARTITION BY frame ORDER BY line), 0) AS after FROM m),
s AS (SELECT *, b - 0.3 * m + 0.2 * (after - before) * 0.5 AS side FROM n)
SELECT frame, line, round(a + side, 9) AS l, round(a - side, 9) AS r FROM s""",
    ),
    "stereo_cues": (
        stereo_cues,
        PAIRS
        + """, c AS (SELECT x.frame, CAST(floor(x.line * 8 / 64.0) AS INTEGER) AS grp, x.a, y.a AS ai, x.b, y.b AS bi FROM pairs x JOIN pairs y ON x.frame = y.frame AND y.line = x.line + 1 WHERE x.line % 2 = 0),
s AS (SELECT frame, grp, sum(a*a + ai*ai) AS el, sum(b*b + bi*bi) AS er, sum(a*b + ai*bi) AS xr, sum(ai*b - a*bi) AS xi FROM c GROUP BY frame, grp)
SELECT frame, grp, CAST(CASE WHEN el + er <= 2.220446049250313e-16 THEN 0 ELSE greatest(-7, least(7, round(1.5 * log2((el + 1e-20) / (er + 1e-20))))) END AS INTEGER) AS level,
  round(CASE WHEN sqrt(el * er) <= 2.220446049250313e-16 THEN 1 ELSE least(1.0, sqrt(xr*xr + xi*xi) / sqrt(el * er)) END, 6) AS correlation FROM s""",
    ),
    "downmix": (downmix, "WITH " + HOURLY + ", mix(src, dst, gain) AS (VALUES " + ", ".join(f"('{s}', '{t}', {g})" for s, t, g in MIX) + ") SELECT t, dst, round(sum(v * gain), 4) AS v FROM hourly JOIN mix USING (src) GROUP BY t, dst"),
    "channel_extend": (
        channel_extend,
        "WITH " + HOURLY + ", layout(ord, label) AS (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(LAYOUT)) + """), frames AS (SELECT DISTINCT t FROM hourly)
SELECT f.t, l.ord, l.label, round(coalesce(h.v, 0), 4) AS v, h.v IS NULL AS padded FROM frames f CROSS JOIN layout l LEFT JOIN hourly h ON h.t = f.t AND h.src = l.label""",
    ),
    "interleave": (interleave, duck("spectra") + "SELECT frame, CAST(row_number() OVER (PARTITION BY frame ORDER BY line, ch) - 1 AS INTEGER) AS pos, v FROM spectra"),
    "dequantize": (
        dequantize,
        """WITH c AS (SELECT (l_partkey % 401) - 200 AS q, (l_suppkey % 61) - 30 AS s, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT q, s, n, round(sign(q) * pow(abs(q), 4.0 / 3.0) * pow(2.0, s / 4.0), 4) AS x FROM c""",
    ),
    "fixed_point": (
        fixed_point,
        duck("spectra")
        + """, q AS (SELECT frame, ch, line, CAST(greatest(-2147483648, least(2147483647, round(greatest(-1.0, least(1.0, v * 1.7)) * 2147483648.0))) AS BIGINT) AS q31,
  CAST(greatest(-32768, least(32767, round(v * 1.7 * 32768.0))) AS INTEGER) AS pcm FROM spectra)
SELECT frame, ch, line, q31, pcm, CAST(greatest(-2147483648, least(2147483647, floor(CAST(q31 * 1518500250 AS HUGEINT) / CAST(2147483648 AS DECIMAL(20,0))))) AS BIGINT) AS scaled,
  CAST(CASE WHEN line % 9 >= 4 THEN greatest(-2147483648, least(2147483647, q31 * CAST(pow(2, line % 9 - 4) AS BIGINT))) ELSE floor(q31 / pow(2, 4 - line % 9)) END AS BIGINT) AS shifted,
  CAST(floor(q31 / 65536.0) AS INTEGER) AS pcm_floor FROM q""",
    ),
    "headroom": (
        headroom,
        duck("spectra")
        + """, q AS (SELECT frame, ch, CAST(greatest(-2147483648, least(2147483647, round(greatest(-1.0, least(1.0, v)) * 2147483648.0))) AS BIGINT) AS q FROM spectra),
m AS (SELECT frame, ch, bit_or(CASE WHEN q < 0 THEN -q - 1 ELSE q END) AS m FROM q GROUP BY frame, ch)
SELECT frame, ch, CAST(greatest(0, CASE WHEN m = 0 THEN 31 ELSE 31 - length(bin(m)) END) AS INTEGER) AS headroom FROM m""",
    ),
    "loudness_gain": (loudness_gain, "SELECT p_partkey, CAST(round(-24.0 + p_size * 0.5, 4) AS DOUBLE) AS gain_db, round(p_retailprice * pow(10.0, (-24.0 + p_size * 0.5) / 20.0) + 1e-9, 4) AS scaled, round(pow(2.0, p_size / 4.0), 4) AS noise_gain FROM part"),
    "mixed_radix": (mixed_radix, "SELECT p_partkey, " + ", ".join(f"CAST(((p_partkey % 81) // {3**k}) % 3 - 1 AS INTEGER) AS d{k}" for k in range(4)) + " FROM part"),
    "rate_index": (
        rate_index,
        "SELECT p_partkey, rate, CAST((SELECT count(*) FROM (VALUES (96000), (48000), (32000), (16000), (8000)) r(x) WHERE x > rate) AS INTEGER) AS rate_index FROM (SELECT p_partkey, p_partkey * 7919 % 100000 AS rate FROM part)",
    ),
    "quantize_band": (quantize_band, _THRESHOLD_SQL),
    "imdct": (
        imdct,
        duck("spectra") + "SELECT frame, ch, CAST(n AS INTEGER) AS n, round(sum(v * cos(pi() / 64 * (n + 0.5 + 32) * (line + 0.5))), 6) AS v FROM spectra, (SELECT unnest(range(0, 128)) AS n) GROUP BY frame, ch, n",
    ),
    "dct4": (dct4, duck("spectra") + "SELECT frame, ch, CAST(n AS INTEGER) AS n, round(sum(v * cos(pi() / 64 * (n + 0.5) * (line + 0.5))), 6) AS v FROM spectra, (SELECT unnest(range(0, 64)) AS n) GROUP BY frame, ch, n"),
    "sine_window": (sine_window, "SELECT i, round(sin(pi() / 256 * (i + 0.5)), 9) AS w FROM (SELECT unnest(range(0, 256)) AS i)"),
    "kaiser_window": (
        kaiser_window,
        """WITH a AS (SELECT i, pi() * 4.0 / 2 * sqrt(1 - pow(2.0 * i / 64 - 1, 2)) AS z FROM (SELECT unnest(range(0, 65)) AS i)),
k AS (SELECT i, sum(pow(pow(z, n) / gamma(n + 1.0), 2)) AS k FROM a, (SELECT unnest(range(0, 41)) AS n) GROUP BY i)
SELECT i, w FROM (SELECT i, round(sqrt(sum(k) OVER (ORDER BY i) / sum(k) OVER ()), 9) AS w FROM k) WHERE i < 64""",
    ),
}

assert BORDERS[-1] == LINES
