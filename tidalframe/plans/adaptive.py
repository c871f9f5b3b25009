"""Queries on adaptive recurrences, filters and patches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import adaptive as A
from ..operators import order as O
from ..operators import transform as X
from .spectral import LINES, MEASURES, _measures
from .views import duck, packets, signal, spectra, table, vectors

PATCHES = ((0, 32, 12), (4, 44, 8), (8, 52, 12))
#: Weights of the parts of a layout that share a budget.
SHARES = ((1, 1.0, 1), (2, 0.62, 2), (3, 0.38, 1), (4, 0.1, 1))


def _v(spark, d):
    return signal(spark, d).select("stream", "t", "v")


def compressor(spark, d):
    return A.compressed(_v(spark, d).withColumn("v", F.col("v") / 100.0), 0.5, 0.1, 2).select("stream", "t", F.round("gain_db", 6).alias("gain_db"))


def weighted_energy(spark, d):
    return A.weighted_energy(_v(spark, d).withColumn("v", F.col("v") / 100.0), 0.9).select("stream", F.round("energy", 6).alias("energy"))


def tracked_range(spark, d):
    return A.tracked_range(_v(spark, d)).select("stream", "t", F.round(F.col("low") + 1e-9, 5).alias("low"), F.round(F.col("high") + 1e-9, 5).alias("high"))


def onset_slot(spark, d):
    return A.onset_slots(_v(spark, d).select("stream", "t", (F.col("v") * F.col("v")).alias("e")), 5.0)


def line_tonality(spark, d):
    return A.line_tonality(spectra(spark, d)).select("ch", "line", F.round("energy", 6).alias("energy"), F.round("tonality", 6).alias("tonality"))


def lattice_filter(spark, d):
    out = vectors(spark, d).select("frame", "ch", F.posexplode(A.lattice(F.col("x"), [0.4, -0.2])).alias("line", "v"))
    return out.select("frame", "ch", "line", F.round("v", 6).alias("v"))


def noise_fill(spark, d):
    out = vectors(spark, d).select("frame", "ch", F.posexplode(A.noise(F.col("frame") * 2 + F.col("ch"), 8)).alias("line", "v"))
    return out.select("frame", "ch", "line", F.round("v", 6).alias("v"))


def patch_copy(spark, d):
    patches = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(s).alias("source"), F.lit(t).alias("target"), F.lit(w).alias("width")) for s, t, w in PATCHES])))
    return A.patched(spectra(spark, d), patches)


def envelope_gain(spark, d):
    return A.followed_envelope(spectra(spark, d), LINES // 2).select("frame", "ch", F.round("gain", 6).alias("gain"))


def spectra_between(spark, d):
    return A.between_frames(_measures(spark, d)).select("frame", "ch", "band", F.round("between", 6).alias("between"))


def analysis_lines(spark, d):
    pairs = vectors(spark, d).groupBy("frame").agg(F.max(F.when(F.col("ch") == 0, F.col("x"))).alias("a"), F.max(F.when(F.col("ch") == 1, F.col("x"))).alias("b")).where("a is not null and b is not null")
    out = pairs.select("frame", F.posexplode(X.mdct(F.concat("a", "b"), LINES)).alias("k", "v"))
    return out.select("frame", "k", F.round("v", 6).alias("v"))


def bit_targets(spark, d):
    shares = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(p).alias("part"), F.lit(w).alias("weight"), F.lit(n).alias("members")) for p, w, n in SHARES])))
    total = sum(w for _, w, _ in SHARES)
    o = table(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").alias("budget"))
    bits = F.floor(F.col("budget") * F.col("weight") / F.lit(total) / F.col("members")) - 7
    return o.join(F.broadcast(shares)).select("o_orderkey", "part", F.greatest(F.lit(0), bits).cast("long").alias("bits"))


def level_steps(spark, d):
    """A piecewise-linear scale: steps of a quarter, then a half, then one, from three offsets."""
    raw = F.col("p_partkey") % 256
    value = F.when(raw < 64, -40 + raw * 0.25).when(raw < 128, -24 + (raw - 64) * 0.5).otherwise(8.0 + (raw - 128))
    return table(spark, d, "part").select("p_partkey", value.cast("double").alias("level"))


def delay_parts(spark, d):
    """A delay in samples as whole frames and the rest, with what the stages in use add."""
    p = F.col("p_partkey")
    total = F.when(p % 2 == 0, 962).otherwise(0) + F.when(p % 3 == 0, 481).otherwise(257) + p % 2048
    return table(spark, d, "part").select("p_partkey", total.cast("long").alias("total")).select("p_partkey", F.expr("total div 1024").alias("frames"), (F.col("total") % 1024).alias("samples"))


def loss_carry(spark, d):
    rows = packets(spark, d).select("unit", "sub", (F.col("bits") * 1000).alias("distance"))
    return O.carried_losses(rows, 44100, 64000, 1024).select("unit", "sub", "lost")


def pulse_apply(spark, d):
    q = spectra(spark, d).select("frame", "ch", "line", (F.col("frame") % 8).cast("int").alias("first"), F.round(F.col("v") * 20).cast("int").alias("q"))
    return O.pulsed(q, [3, 5, 2, 7], [1, 2, 3, 4]).select("frame", "ch", "line", "q")


def step_energy(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 40).alias("v"))
    return p.select("p_partkey", F.round(64.0 * F.pow(F.lit(2.0), F.col("v") / 2.0), 4).alias("energy"), F.round(F.pow(F.lit(2.0), 6.0 - F.col("v") % 31), 9).alias("noise"))


_SIGNAL = duck("signal").replace("WITH ", "WITH RECURSIVE ")

QUERIES = {
    "compressor": (
        compressor,
        _SIGNAL
        + """, l AS (SELECT stream, t, least(0.0, -0.5 * (20 * log10(greatest(abs(v / 100.0), 1e-5)) + 20)) AS g FROM signal),
c AS (SELECT DISTINCT stream, CAST(-1 AS BIGINT) AS t, CAST(0 AS DOUBLE) AS gain, 0 AS waited FROM signal
UNION ALL SELECT l.stream, l.t, CASE WHEN g < gain THEN gain + 0.5 * (g - gain) WHEN waited < 2 THEN gain ELSE gain + 0.1 * (g - gain) END, CASE WHEN g < gain THEN 0 WHEN waited < 2 THEN waited + 1 ELSE waited END
FROM c JOIN l ON l.stream = c.stream AND l.t = c.t + 1) SELECT stream, t, round(gain, 6) AS gain_db FROM c WHERE t >= 0""",
    ),
    "weighted_energy": (
        weighted_energy,
        _SIGNAL
        + """, c AS (SELECT DISTINCT stream, CAST(-1 AS BIGINT) AS t, CAST(0 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y FROM signal
UNION ALL SELECT s.stream, s.t, s.v / 100.0, s.v / 100.0 - x + 0.9 * y FROM c JOIN signal s ON s.stream = c.stream AND s.t = c.t + 1)
SELECT stream, round(avg(y * y), 6) AS energy FROM c WHERE t >= 0 GROUP BY stream""",
    ),
    "tracked_range": (
        tracked_range,
        _SIGNAL
        + """, c AS (SELECT stream, CAST(-1 AS BIGINT) AS t, v AS low, v AS high FROM signal WHERE t = 0
UNION ALL SELECT stream, t, CASE WHEN h - l >= v / 6 THEN l WHEN below + above > 0 THEN greatest(v - below / (below + above) * v / 6, 0) ELSE greatest(v - v / 12, 0) END,
  CASE WHEN h - l >= v / 6 THEN h WHEN below + above > 0 THEN v + above / (below + above) * v / 6 ELSE v + v / 12 END FROM (
  SELECT *, greatest(v - l, 0) AS below, greatest(h - v, 0) AS above FROM (
    SELECT s.stream, s.t, s.v, CASE WHEN s.v > high THEN low + 0.3 * (s.v - high) WHEN s.v < low THEN low - 0.14 * (low - s.v) ELSE low + 0.3 * (s.v - low) END AS l,
      CASE WHEN s.v > high THEN high + (s.v - high) WHEN s.v < low THEN high - 0.07 * (low - s.v) ELSE high - 0.07 * (high - s.v) END AS h
    FROM c JOIN signal s ON s.stream = c.stream AND s.t = c.t + 1))) SELECT stream, t, round(low + 1e-9, 5) AS low, round(high + 1e-9, 5) AS high FROM c WHERE t >= 0""",
    ),
    "onset_slot": (
        onset_slot,
        duck("signal")
        + """, r AS (SELECT stream, t, v * v / (lag(v * v) OVER (PARTITION BY stream ORDER BY t) + 0.01) AS r FROM signal)
SELECT stream, t FROM r WHERE r >= 5 QUALIFY row_number() OVER (PARTITION BY stream ORDER BY r DESC, t DESC) = 1""",
    ),
    "line_tonality": (
        line_tonality,
        duck("spectra")
        + """, b AS (SELECT *, lag(v) OVER (PARTITION BY ch, line ORDER BY frame) AS p FROM spectra)
SELECT ch, line, round(sum(v * v), 6) AS energy, round(CASE WHEN sqrt(sum(v * v) FILTER (WHERE p IS NOT NULL) * sum(p * p)) > 1e-30 THEN least(1.0, abs(sum(v * p)) / sqrt(sum(v * v) FILTER (WHERE p IS NOT NULL) * sum(p * p))) ELSE 0 END, 6) AS tonality
FROM b GROUP BY ch, line""",
    ),
    "lattice_filter": (
        lattice_filter,
        duck("spectra").replace("WITH ", "WITH RECURSIVE ")
        + """, c AS (SELECT DISTINCT frame, ch, -1 AS line, CAST(0 AS DOUBLE) AS s0, CAST(0 AS DOUBLE) AS s1 FROM spectra
UNION ALL SELECT s.frame, s.ch, s.line, s.v + 0.2 * c.s1 - 0.4 * c.s0, c.s0 + 0.4 * (s.v + 0.2 * c.s1 - 0.4 * c.s0) FROM c JOIN spectra s ON s.frame = c.frame AND s.ch = c.ch AND s.line = c.line + 1)
SELECT frame, ch, line, round(s0, 6) AS v FROM c WHERE line >= 0""",
    ),
    "noise_fill": (
        noise_fill,
        """WITH RECURSIVE v AS (SELECT DISTINCT vec_id FROM embeddings WHERE embedding IS NOT NULL),
c AS (SELECT vec_id, -1 AS line, vec_id AS s FROM v UNION ALL SELECT vec_id, line + 1, (s * 1664525 + 1013904223) % 4294967296 FROM c WHERE line < 7),
x AS (SELECT vec_id, line, CAST(CASE WHEN s >= 2147483648 THEN s - 4294967296 ELSE s END AS DOUBLE) AS x FROM c WHERE line >= 0)
SELECT vec_id // 2 AS frame, CAST(vec_id % 2 AS INTEGER) AS ch, line, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS v FROM x""",
    ),
    "patch_copy": (
        patch_copy,
        duck("spectra") + ", p(source, target, width) AS (VALUES " + ", ".join(map(str, PATCHES)) + ") SELECT frame, ch, CAST(target + line - source AS INTEGER) AS line, v FROM spectra JOIN p ON line >= source AND line < source + width",
    ),
    "envelope_gain": (
        envelope_gain,
        duck("spectra")
        + """, p AS (SELECT frame, ch, sum(CASE WHEN line < 32 THEN v * v ELSE 0 END) AS low, sum(CASE WHEN line >= 32 THEN v * v ELSE 0 END) AS high FROM spectra GROUP BY frame, ch),
r AS (SELECT *, low / greatest(avg(low) OVER (PARTITION BY ch), 1e-30) AS raw, sum(high) OVER (PARTITION BY ch) AS total FROM p)
SELECT frame, ch, round(sqrt(raw * total / greatest(sum(raw * high) OVER (PARTITION BY ch), 1e-30)), 6) AS gain FROM r""",
    ),
    "spectra_between": (spectra_between, MEASURES + "SELECT frame, ch, band, round(sqrt(lag(energy) OVER w * lead(energy) OVER w), 6) AS between FROM measures WINDOW w AS (PARTITION BY ch, band ORDER BY frame)".replace("AS between", 'AS "between"')),
    "analysis_lines": (
        analysis_lines,
        duck("spectra")
        + """, x AS (SELECT frame, ch * 64 + line AS n, v FROM spectra WHERE frame IN (SELECT frame FROM spectra GROUP BY frame HAVING count(DISTINCT ch) = 2))
SELECT frame, CAST(k AS INTEGER) AS k, round(sum(v * sin(pi() / 128 * (n + 0.5)) * cos(pi() / 64 * (n + 0.5 + 32) * (k + 0.5)) * sqrt(2.0 / 64)), 6) AS v FROM x, (SELECT unnest(range(0, 64)) AS k) GROUP BY frame, k""",
    ),
    "bit_targets": (
        bit_targets,
        "WITH s(part, weight, members) AS (VALUES " + ", ".join(f"({p}, CAST({w} AS DOUBLE), {n})" for p, w, n in SHARES) + f""")
SELECT o_orderkey, part, CAST(greatest(0, floor(CAST(floor(o_totalprice) AS BIGINT) * weight / CAST({sum(w for _, w, _ in SHARES)!r} AS DOUBLE) / members) - 7) AS BIGINT) AS bits FROM orders, s""",
    ),
    "level_steps": (
        level_steps,
        "SELECT p_partkey, CAST(CASE WHEN r < 64 THEN -40 + r * 0.25 WHEN r < 128 THEN -24 + (r - 64) * 0.5 ELSE 8.0 + (r - 128) END AS DOUBLE) AS level FROM (SELECT p_partkey, p_partkey % 256 AS r FROM part)",
    ),
    "loss_carry": (
        loss_carry,
        duck("packets")
        + """, s AS (SELECT unit, sub, CAST(sum(bits * 1000 * 44100) OVER (PARTITION BY unit ORDER BY sub) AS BIGINT) // (64000 * 1024) AS u FROM packets)
SELECT unit, sub, CAST(u - lag(u, 1, 0) OVER (PARTITION BY unit ORDER BY sub) AS BIGINT) AS lost FROM s""",
    ),
    "pulse_apply": (
        pulse_apply,
        duck("spectra")
        + """, q AS (SELECT frame, ch, line, CAST(round(v * 20) AS INTEGER) AS q, line - CAST(frame % 8 AS INTEGER) AS k FROM spectra),
p(k, a) AS (VALUES (3, 1), (8, 2), (10, 3), (17, 4)) SELECT frame, ch, line, CAST(CASE WHEN p.a IS NULL THEN q WHEN q > 0 THEN q + p.a ELSE q - p.a END AS INTEGER) AS q FROM q LEFT JOIN p USING (k)""",
    ),
    "step_energy": (step_energy, "SELECT p_partkey, round(64.0 * pow(2.0, (p_partkey % 40) / 2.0), 4) AS energy, round(pow(2.0, 6.0 - (p_partkey % 40) % 31), 9) AS noise FROM part"),
    "delay_parts": (
        delay_parts,
        """SELECT p_partkey, CAST(d // 1024 AS BIGINT) AS frames, CAST(d % 1024 AS BIGINT) AS samples FROM (SELECT p_partkey,
  CASE WHEN p_partkey % 2 = 0 THEN 962 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 481 ELSE 257 END + p_partkey % 2048 AS d FROM part)""",
    ),
}

