"""Queries on rate control, resets, selection and windows; each oracle is written from the survey's wording."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import adaptive as A
from ..operators import control as K
from ..operators import order as O
from ..operators import transform as X
from .views import BORDERS, banded, bands, duck, packets, signal, spectra, table, vectors

LINES = 64
#: Samples are brought to the 16-bit scale that the onset rule expects, halved.
PCM = 300.0 / 65536.0
WIDTH = 2
#: The curve of ``profile_gain``, its weights, its steps in dB and its hold in rows.
KNOTS = {"most_boost_at": -40.0, "most_boost": 6.0, "boost_at": -25.0, "boost_slope": -0.4, "early_at": -15.0, "early_slope": -0.5, "cut_at": -8.0, "cut_slope": -0.8, "most_cut_at": 5.0, "most_cut": 13.9}
WEIGHTS = {"fast_attack": 0.9, "slow_attack": 0.5, "fast_decay": 0.3, "slow_decay": 0.1}
STEPS, HOLD = {"attack": 15.0, "decay": 20.0}, 2
BITS, GROUPED_BITS, FIT_BITS = 160, 300, 140
BITRATES, RATE = (32000, 64000, 128000), 44100
FADE, FADE_ROWS = 0.70710677, 6
NOISE_BANDS, NOISE_WIDTH = 6, 4
DELAY = 3


def _v(spark, d):
    return signal(spark, d).select("stream", "t", "v", "kind")


def onset_windows(spark, d):
    return K.window_onsets(_v(spark, d).select("stream", "t", (F.col("v") * PCM).alias("v")), WIDTH)


def profile_gain(spark, d):
    levels = _v(spark, d).select("stream", "t", (F.col("v") * 0.6 - 50.0).alias("level"))
    return K.profile_gains(levels, KNOTS, WEIGHTS, STEPS, HOLD).select("stream", "t", F.round(F.col("gain") + 1e-9, 6).alias("gain"))


def _lines(spark, d):
    """Lines with the noise that their band may have: a fiftieth of its mean energy."""
    rows = banded(spectra(spark, d))
    noise = rows.groupBy("frame", "ch", "band").agg((F.avg(F.col("v") * F.col("v")) / 50.0 + 1e-9).alias("allowed"))
    return rows.join(noise, ["frame", "ch", "band"])


def rate_loop(spark, d):
    return K.rate_loops(_lines(spark, d), ["frame", "ch"], BITS)


def rate_loop_grouped(spark, d):
    """Two frames share a group: one noise and one target for both."""
    rows = banded(spectra(spark, d)).withColumn("grp", F.expr("frame div 2"))
    noise = rows.groupBy("grp", "ch", "band").agg((F.avg(F.col("v") * F.col("v")) / 50.0 + 1e-9).alias("allowed"))
    return K.rate_loops(rows.join(noise, ["grp", "ch", "band"]), ["grp", "ch"], GROUPED_BITS)


def rate_fit(spark, d):
    out = K.rate_fits(_lines(spark, d), ["frame", "ch"], FIT_BITS)
    return out.select("frame", "ch", F.round("relaxation", 6).alias("relaxation"), "bits")


def section_choice(spark, d):
    p = packets(spark, d)
    costs = F.array(F.when(F.col("bytes") % 7 != 6, F.col("bytes") % 7).cast("double"), (F.col("bytes") % 5 * 3 + 1).cast("double"), (F.col("bytes") % 11).cast("double"))
    rows = p.groupBy("unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("sub", costs.alias("c")))), lambda z: z["c"]).alias("x"))
    return K.chosen_sections(rows, "unit", 3)


def grant_factor(spark, d):
    p = packets(spark, d)
    rows = p.select("unit", "sub", (F.col("bits") + 200).cast("double").alias("demand"), (F.col("bits") * 0.9 + 190).alias("granted"))
    spent = F.when(F.col("sub") % 5 != 4, F.lag(F.col("granted") * (0.8 + F.col("sub") % 3 * 0.2)).over(O.Window.partitionBy("unit").orderBy("sub")))
    out = K.corrected_grants(rows.withColumn("spent", spent))
    return out.select("unit", "sub", F.round("factor", 6).alias("factor"), F.round("grant", 4).alias("grant"))


def bandwidth_smooth(spark, d):
    modes = _v(spark, d).select("stream", "t", (F.floor("v") % 4).cast("int").alias("mode"))
    return K.smoothed_bandwidths(modes).select("stream", "t", F.round(F.col("bandwidth") + 1e-9, 6).alias("bandwidth"))


def control_reset(spark, d):
    """Errors are lost units; a signup interrupts the stream, a purchase clears its buffers, a view its history."""
    kind, size = F.col("kind"), F.floor("v").cast("long")
    rows = _v(spark, d)
    sums = {
        "lost": ((kind == "error").cast("long"), kind.isin("signup", "purchase")),
        "pending": ((kind == "error").cast("long"), kind.isin("signup", "view")),
        "total_bytes": (size, kind == "purchase"),
        "bad_bytes": (F.when(kind == "error", size).otherwise(0), kind == "purchase"),
    }
    return K.since_reset(rows, sums).select("stream", "t", *sums)


def control_output(spark, d):
    kind = F.col("kind")
    flag = F.when(kind == "view", "conceal").when(kind == "signup", "interrupt").when(kind == "purchase", "flush")
    rows = _v(spark, d).select("stream", "t", F.when(kind != "error", F.col("v")).alias("v"), flag.alias("flag"))
    return K.flagged_output(rows, FADE, FADE_ROWS).select("stream", "t", F.round("out", 6).alias("out"))


def delay_replace(spark, d):
    out = K.delay_replaced(_v(spark, d), DELAY, F.col("kind") == "error", -F.col("v"))
    return out.select("stream", "t", "delayed")


def noise_pair(spark, d):
    frames = vectors(spark, d).select("frame").distinct()
    flag = lambda m, r: F.transform(F.sequence(F.lit(0), F.lit(NOISE_BANDS - 1)), lambda b: (F.col("frame") + b) % m == r)
    rows = frames.select("frame", F.col("frame").alias("seed"), flag(2, 0).alias("left"), flag(3, 0).alias("right"), flag(4, 0).alias("shared"))
    out = K.noise_pairs(rows, NOISE_WIDTH, A.NOISE_GENERATORS["band"])
    out = out.select("frame", F.posexplode(F.arrays_zip("x", "y")).alias("line", "z"))
    return out.select("frame", "line", F.round("z.x", 6).alias("x"), F.round("z.y", 6).alias("y"))


def band_snr(spark, d):
    rates = spark.range(1).select(F.explode(F.array(*[F.lit(b) for b in BITRATES])).alias("bitrate"))
    rows = bands(spark).join(F.broadcast(rates))
    return K.least_snr(rows, LINES, RATE, BORDERS[-1]).select("bitrate", "band", F.round("snr", 6).alias("snr"))


def short_overlap(spark, d):
    blocks = vectors(spark, d).select("ch", "frame", X.short_blocks(F.col("x"), LINES, 8).alias("x"))
    return O.overlap_added(blocks).select("ch", "frame", "line", F.round("v", 6).alias("v"))


def switched_window(spark, d):
    rows = spark.range(2 * LINES).select(F.col("id").alias("i")).join(F.broadcast(spark.range(1).select(F.explode(F.array(F.lit("long"), F.lit("start"), F.lit("stop"))).alias("sequence"))))
    before, now = X.sine_shape, X.power_shape
    return rows.select("sequence", "i", F.round(X.switched_window(F.col("sequence"), F.col("i"), LINES, 8, before, now), 9).alias("w"))


def one_band_gain(spark, d):
    """A control byte's gain, with a reference level where one is known, null where the channel is left out."""
    p = F.col("p_partkey")
    level = F.when(p % 3 != 0, (p % 40).cast("double"))
    out = X.control_gain((p % 256).cast("int"), 0.8, 0.5, F.lit(31.0), level)
    return table(spark, d, "part").select("p_partkey", F.round(F.when(p % 11 != 0, out), 6).alias("gain"))


def concealed_scales(spark, d):
    p = F.col("p_partkey")
    kind, gain, noise = (p % 32).cast("int"), (p % 256).cast("int"), F.when(p % 2 == 0, (p % 90).cast("int"))
    return table(spark, d, "part").select("p_partkey", X.concealed_scale(kind, gain, noise).alias("scale"))


def coupled_energy(spark, d):
    """Level and balance of two channels as their energies, in steps of one and of a half."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 30).alias("level"), (F.col("p_partkey") % 25).alias("balance"), F.when(F.col("p_partkey") % 2 == 0, 1.0).otherwise(2.0).alias("steps"))
    ratio = F.pow(F.lit(2.0), F.col("balance") / F.col("steps") - 12.0)
    right = 2.0 * 64.0 * F.pow(F.lit(2.0), F.col("level") / F.col("steps")) / (ratio + 1.0)
    return p.select("p_partkey", F.round(ratio * right, 4).alias("left_energy"), F.round(right, 4).alias("right_energy"))


def band_offsets(spark, d):
    """Borders and widths of the bands, and how many lines of the spectra each holds."""
    rows = banded(spectra(spark, d)).groupBy("band").agg(F.count("*").alias("n"), F.min("line").alias("first"), F.max("line").alias("last"))
    return bands(spark).join(F.broadcast(rows), "band").select("band", "start", "stop", (F.col("stop") - F.col("start")).alias("width"), "n", "first", "last")


def dequantize_lines(spark, d):
    """Quantised lines to the power 4/3 by the scale of their band."""
    rows = banded(spectra(spark, d)).select("frame", "ch", "line", "band", F.round(F.col("v") * 20).cast("int").alias("q"))
    x = F.signum(F.col("q").cast("double")) * F.pow(F.abs("q").cast("double"), 4.0 / 3.0) * F.pow(F.lit(2.0), (F.col("band") * 3 - 10) / 4.0)
    return rows.select("frame", "ch", "line", F.round(x, 5).alias("x"))


def set_options(spark, d):
    """Settings as they come: the last one within its range counts, else the default of 50."""
    ok = (F.col("v") >= 10) & (F.col("v") <= 90)
    kept = F.last(F.when(ok, F.col("v")), ignorenulls=True).over(O.so_far())
    rows = _v(spark, d).withColumns({"kept": kept, "accepted": ok})
    return rows.select("stream", "t", "accepted", F.round(F.coalesce("kept", F.lit(50.0)), 6).alias("setting"))


_SIGNAL = duck("signal").replace("WITH ", "WITH RECURSIVE ")
_V = duck("signal")
_BITS = lambda v, a: f"CASE WHEN floor(abs({v}) / sqrt({a}) + 0.5) = 0 THEN 1 ELSE 2 * length(bin(CAST(floor(abs({v}) / sqrt({a}) + 0.5) AS BIGINT))) + 1 END"
_BAND = "(" + " + ".join(f"CAST(line >= {b} AS INTEGER)" for b in BORDERS[1:-1]) + ")"
_ALLOWED = f"""b AS (SELECT *, {_BAND} AS band FROM spectra),
l AS (SELECT *, avg(v * v) OVER (PARTITION BY frame, ch, band) / 50.0 + 1e-9 AS a FROM b)"""


def _loop_sql(keys: str, rows: str, target: int) -> str:
    return f"""{rows}, k AS (SELECT unnest(range(0, 13)) AS k), s AS (SELECT {keys}, k, sum({_BITS("v", "(a * pow(2.0, k))")}) AS bits FROM l, k GROUP BY {keys}, k)
SELECT {keys}, CAST(coalesce(min(k) FILTER (WHERE bits <= {target}), 12) AS INTEGER) AS doublings, CAST(coalesce(arg_min(bits, k) FILTER (WHERE bits <= {target}), min(bits) FILTER (WHERE k = 12)) AS BIGINT) AS bits FROM s GROUP BY {keys}"""


_K = KNOTS
_SIDE = "(4 + 5 * (({n}) // 31 + 1))"

QUERIES = {
    "onset_windows": (
        onset_windows,
        _SIGNAL
        + f""", f AS (SELECT DISTINCT stream, CAST(-1 AS BIGINT) AS t, CAST(0 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y FROM signal
UNION ALL SELECT s.stream, s.t, s.v * {PCM!r}, 0.7548 * (s.v * {PCM!r} - f.x) + 0.5095 * f.y FROM f JOIN signal s ON s.stream = f.stream AND s.t = f.t + 1),
w AS (SELECT stream, t // 8 AS frame, sum(CASE WHEN t % 8 < 2 THEN y * y ELSE 0 END) AS e0, sum(CASE WHEN t % 8 IN (2, 3) THEN y * y ELSE 0 END) AS e1,
  sum(CASE WHEN t % 8 IN (4, 5) THEN y * y ELSE 0 END) AS e2, sum(CASE WHEN t % 8 > 5 THEN y * y ELSE 0 END) AS e3 FROM f WHERE t >= 0 GROUP BY stream, t // 8 HAVING count(*) = 8),
r AS (SELECT DISTINCT stream, CAST(-1 AS BIGINT) AS frame, CAST(0 AS DOUBLE) AS acc, CAST(0 AS DOUBLE) AS held, -1 AS place FROM w
UNION ALL SELECT stream, frame, 0.7 * (0.7 * (0.7 * (0.7 * acc + 0.3 * held) + 0.3 * e0) + 0.3 * e1) + 0.3 * e2, e3,
  CASE WHEN hit >= 0 AND greatest(e0, e1, e2, e3) >= {1_000_000.0 / (32_768.0 * 32_768.0 * 128.0)!r} THEN hit WHEN place = 3 AND held > 10 * e1 THEN 0 ELSE -1 END FROM (
  SELECT w.*, r.acc, r.held, r.place, CASE WHEN 0.1 * e3 > 0.7 * (0.7 * (0.7 * (0.7 * acc + 0.3 * held) + 0.3 * e0) + 0.3 * e1) + 0.3 * e2 THEN 3
    WHEN 0.1 * e2 > 0.7 * (0.7 * (0.7 * acc + 0.3 * held) + 0.3 * e0) + 0.3 * e1 THEN 2 WHEN 0.1 * e1 > 0.7 * (0.7 * acc + 0.3 * held) + 0.3 * e0 THEN 1 WHEN 0.1 * e0 > 0.7 * acc + 0.3 * held THEN 0 ELSE -1 END AS hit
  FROM r JOIN w ON w.stream = r.stream AND w.frame = r.frame + 1))
SELECT stream, frame, place >= 0 AS attack, place FROM r WHERE frame >= 0""",
    ),
    "profile_gain": (
        profile_gain,
        _SIGNAL
        + f""", x AS (SELECT stream, t, v * 0.6 - 50.0 AS level FROM signal),
l AS (SELECT *, CASE WHEN level <= {_K["most_boost_at"]} THEN {_K["most_boost"]} WHEN level < {_K["boost_at"]} THEN (level - {_K["boost_at"]}) * {_K["boost_slope"]} WHEN level <= {_K["early_at"]} THEN 0.0
  WHEN level <= {_K["cut_at"]} THEN (level - {_K["early_at"]}) * {_K["early_slope"]} WHEN level < {_K["most_cut_at"]} THEN (level - {_K["cut_at"]}) * {_K["cut_slope"]} + ({_K["cut_at"]} - {_K["early_at"]}) * {_K["early_slope"]} ELSE -{_K["most_cut"]} END AS g FROM x),
c AS (SELECT DISTINCT stream, CAST(-1 AS BIGINT) AS t, CAST(0 AS DOUBLE) AS smooth, CAST(0 AS DOUBLE) AS gain, 0 AS held FROM signal
UNION ALL SELECT stream, t, smooth + moves * alpha * (level - smooth), gain + moves * alpha * (g - gain), CASE WHEN g < gain + moves * alpha * (g - gain) THEN {HOLD} ELSE greatest(0, held - 1) END FROM (
  SELECT l.*, c.smooth, c.gain, c.held, CASE WHEN l.g < c.gain OR c.held = 0 THEN 1 ELSE 0 END AS moves,
    CASE WHEN l.g < c.gain THEN CASE WHEN l.level - c.smooth > {STEPS["attack"]} THEN {WEIGHTS["fast_attack"]} ELSE {WEIGHTS["slow_attack"]} END WHEN l.level - c.smooth < -{STEPS["decay"]} THEN {WEIGHTS["fast_decay"]} ELSE {WEIGHTS["slow_decay"]} END AS alpha
  FROM c JOIN l ON l.stream = c.stream AND l.t = c.t + 1))
SELECT stream, t, round(gain + 1e-9, 6) AS gain FROM c WHERE t >= 0""",
    ),
    "rate_loop": (rate_loop, _loop_sql("frame, ch", duck("spectra") + ", " + _ALLOWED, BITS)),
    "rate_loop_grouped": (
        rate_loop_grouped,
        _loop_sql("grp, ch", duck("spectra") + f", b AS (SELECT *, {_BAND} AS band, frame // 2 AS grp FROM spectra), l AS (SELECT *, avg(v * v) OVER (PARTITION BY grp, ch, band) / 50.0 + 1e-9 AS a FROM b)", GROUPED_BITS),
    ),
    "rate_fit": (
        rate_fit,
        duck("spectra").replace("WITH ", "WITH RECURSIVE ")
        + f""", {_ALLOWED}, k AS (SELECT unnest(range(0, 13)) AS k), s AS (SELECT frame, ch, k, sum({_BITS("v", "(a * pow(2.0, k))")}) AS bits FROM l, k GROUP BY frame, ch, k),
n AS (SELECT frame, ch, coalesce(min(k) FILTER (WHERE bits <= {FIT_BITS}), 12) AS k, min(bits) <= {FIT_BITS} AS fits FROM s GROUP BY frame, ch),
x AS (SELECT frame, ch, list({{'v': v, 'a': a}}) AS x FROM l GROUP BY frame, ch),
r AS (SELECT n.frame, n.ch, x, 0 AS i, pow(2.0, k) / 2 AS low, pow(2.0, k) AS high, n.k > 0 AND fits AS going FROM n JOIN x ON x.frame = n.frame AND x.ch = n.ch
UNION ALL SELECT frame, ch, x, i + 1, CASE WHEN bits <= {FIT_BITS} THEN low ELSE (low + high) * 0.5 END, CASE WHEN bits <= {FIT_BITS} THEN (low + high) * 0.5 ELSE high END, going FROM (
  SELECT *, list_sum(list_transform(x, lambda z: {_BITS("z.v", "(z.a * ((low + high) * 0.5))")})) AS bits FROM r WHERE i < 10 AND going))
SELECT frame, ch, round(high, 6) AS relaxation, CAST(list_sum(list_transform(x, lambda z: {_BITS("z.v", "(z.a * high)")})) AS BIGINT) AS bits FROM r WHERE i = CASE WHEN going THEN 10 ELSE 0 END""",
    ),
    "section_choice": (
        section_choice,
        duck("packets").replace("WITH ", "WITH RECURSIVE ")
        + f""", u AS (SELECT unit, count(*) AS n, list([CASE WHEN bytes % 7 <> 6 THEN bytes % 7 ELSE 1000000000 END, bytes % 5 * 3 + 1, bytes % 11] ORDER BY sub) AS c FROM packets GROUP BY unit),
r AS (SELECT unit, n, c, CAST(0 AS BIGINT) AS i, [CAST(0 AS BIGINT)] AS best, CAST(NULL AS STRUCT(w BIGINT, s BIGINT, k BIGINT)) AS way FROM u
UNION ALL SELECT unit, n, c, i + 1, list_append(best, now.w), now FROM (
  SELECT *, list_sort(flatten(list_transform(range(0, i + 1), lambda s: list_transform(range(0, 3), lambda k: {{'w': CAST(best[s + 1] + list_sum(list_transform(c[s + 1:i + 1], lambda q: q[k + 1])) + {_SIDE.format(n="i + 1 - s")} AS BIGINT), 's': s, 'k': k}}))))[1] AS now FROM r WHERE i < n)),
t AS (SELECT unit, n AS stop FROM u UNION ALL SELECT t.unit, r.way.s FROM t JOIN r ON r.unit = t.unit AND r.i = t.stop WHERE t.stop > 0)
SELECT t.unit, CAST(r.way.s AS INTEGER) AS start, CAST(t.stop AS INTEGER) AS stop, CAST(r.way.k AS INTEGER) AS choice,
  CAST(list_sum(list_transform(c[r.way.s + 1:t.stop], lambda q: q[r.way.k + 1])) + {_SIDE.format(n="t.stop - r.way.s")} AS BIGINT) AS bits FROM t JOIN r ON r.unit = t.unit AND r.i = t.stop WHERE t.stop > 0""",
    ),
    "grant_factor": (
        grant_factor,
        duck("packets").replace("WITH ", "WITH RECURSIVE ")
        + """, g AS (SELECT unit, sub, CAST(bits + 200 AS DOUBLE) AS demand, bits * CAST(0.9 AS DOUBLE) + 190 AS granted FROM packets),
p AS (SELECT *, CASE WHEN sub % 5 <> 4 THEN lag(granted * (CAST(0.8 AS DOUBLE) + sub % 3 * CAST(0.2 AS DOUBLE))) OVER (PARTITION BY unit ORDER BY sub) END AS spent FROM g),
c AS (SELECT DISTINCT unit, CAST(-1 AS BIGINT) AS sub, CAST(1 AS DOUBLE) AS factor, CAST(0 AS DOUBLE) AS last, CAST(0 AS DOUBLE) AS given FROM p
UNION ALL SELECT unit, sub, new, granted, granted * new FROM (SELECT *, CASE WHEN NOT steady THEN CAST(1 AS DOUBLE) ELSE least(1.15, greatest(0.85, (1 - weight) * base + weight * wanted)) END AS new FROM (
  SELECT *, CASE WHEN base < 1 AND wanted < base OR base > 1 AND wanted > base THEN 0.15 ELSE 0.3 END AS weight FROM (
    SELECT *, CASE WHEN (wanted - 1) * (factor - 1) < 0 THEN CAST(1 AS DOUBLE) ELSE factor END AS base FROM (
      SELECT p.unit, p.sub, p.granted, c.factor, coalesce(p.spent > 0 AND p.demand < 1.5 * c.last AND p.demand > 0.7 * c.last AND 1.2 * p.spent > c.last AND 0.65 * p.spent < c.last, false) AS steady,
        CASE WHEN c.last <= p.spent THEN greatest(0.85, least(1.0, 1.1 * c.last / p.spent)) ELSE greatest(1.0, least(1.15, 0.9 * c.last / p.spent)) END AS wanted
      FROM c JOIN p ON p.unit = c.unit AND p.sub = c.sub + 1)))))
SELECT unit, sub, round(factor, 6) AS factor, round(given, 4) AS "grant" FROM c WHERE sub >= 0""",
    ),
    "bandwidth_smooth": (
        bandwidth_smooth,
        _SIGNAL
        + """, m AS (SELECT stream, t, CAST(floor(v) AS BIGINT) % 4 AS mode, coalesce(lag(CAST(floor(v) AS BIGINT) % 4) OVER (PARTITION BY stream ORDER BY t), 0) AS old FROM signal),
g AS (SELECT stream, t, CAST(CASE WHEN mode = 1 AND old = 0 THEN 0.6 WHEN mode = 1 THEN 0.75 WHEN mode = 2 THEN 0.9 WHEN mode = 3 THEN 0.98 WHEN old = 1 THEN 0.6 ELSE 0 END AS DOUBLE) AS target FROM m),
c AS (SELECT DISTINCT stream, CAST(-1 AS BIGINT) AS t, CAST(0 AS DOUBLE) AS b FROM g
UNION ALL SELECT stream, t, CASE WHEN x < 0.015625 THEN 0 ELSE least(x, 0.99609375) END FROM (SELECT g.stream, g.t, CASE WHEN g.target < c.b THEN 0.75 * g.target + 0.25 * c.b ELSE 0.90625 * g.target + 0.09375 * c.b END AS x FROM c JOIN g ON g.stream = c.stream AND g.t = c.t + 1))
SELECT stream, t, round(b + 1e-9, 6) AS bandwidth FROM c WHERE t >= 0""",
    ),
    "control_reset": (
        control_reset,
        _SIGNAL
        + """, c AS (SELECT DISTINCT stream, CAST(-1 AS BIGINT) AS t, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS pending, CAST(0 AS BIGINT) AS total_bytes, CAST(0 AS BIGINT) AS bad_bytes FROM signal
UNION ALL SELECT s.stream, s.t, CASE WHEN kind IN ('signup', 'purchase') THEN 0 WHEN kind = 'error' THEN lost + 1 ELSE lost END, CASE WHEN kind IN ('signup', 'view') THEN 0 WHEN kind = 'error' THEN pending + 1 ELSE pending END,
  CASE WHEN kind = 'purchase' THEN 0 ELSE total_bytes + CAST(floor(v) AS BIGINT) END, CASE WHEN kind = 'purchase' THEN 0 WHEN kind = 'error' THEN bad_bytes + CAST(floor(v) AS BIGINT) ELSE bad_bytes END
FROM c JOIN signal s ON s.stream = c.stream AND s.t = c.t + 1) SELECT stream, t, lost, pending, total_bytes, bad_bytes FROM c WHERE t >= 0""",
    ),
    "control_output": (
        control_output,
        _SIGNAL
        + f""", c AS (SELECT DISTINCT stream, CAST(-1 AS BIGINT) AS t, CAST(0 AS DOUBLE) AS out, CAST(NULL AS DOUBLE) AS good, CAST(0 AS BIGINT) AS k, CAST(NULL AS DOUBLE) AS held FROM signal
UNION ALL SELECT s.stream, s.t, CASE WHEN kind IN ('click', 'signup') THEN v WHEN kind = 'purchase' THEN coalesce(held, 0) WHEN k < {FADE_ROWS} THEN coalesce(good, 0) * pow({FADE}, k + 1) ELSE 0 END,
  CASE WHEN kind IN ('click', 'signup') THEN v ELSE good END, CASE WHEN kind IN ('click', 'signup') THEN 0 ELSE k + 1 END, CASE WHEN kind <> 'error' THEN v END
FROM c JOIN signal s ON s.stream = c.stream AND s.t = c.t + 1) SELECT stream, t, round(out, 6) AS out FROM c WHERE t >= 0""",
    ),
    "delay_replace": (
        delay_replace,
        _SIGNAL
        + f""", c AS (SELECT DISTINCT stream, CAST(-1 AS BIGINT) AS t, [CAST(0 AS DOUBLE), 0, 0] AS line, CAST(0 AS DOUBLE) AS delayed FROM signal
UNION ALL SELECT s.stream, s.t, list_append(CASE WHEN kind = 'error' THEN list_transform(line, lambda x: -abs(x)) ELSE line END[2:{DELAY}], v), CASE WHEN kind = 'error' THEN list_transform(line, lambda x: -abs(x)) ELSE line END[1]
FROM c JOIN signal s ON s.stream = c.stream AND s.t = c.t + 1) SELECT stream, t, delayed FROM c WHERE t >= 0""",
    ),
    "noise_pair": (
        noise_pair,
        f"""WITH RECURSIVE f AS (SELECT DISTINCT vec_id // 2 AS frame FROM embeddings WHERE embedding IS NOT NULL),
b AS (SELECT frame, band, (frame + band) % 2 = 0 AS l, (frame + band) % 3 = 0 AS r, (frame + band) % 4 = 0 AS s FROM f, (SELECT unnest(range(0, {NOISE_BANDS})) AS band)),
d AS (SELECT *, sum(CASE WHEN l AND r AND s THEN 1 ELSE CAST(l AS INTEGER) + CAST(r AS INTEGER) END) OVER (PARTITION BY frame ORDER BY band ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  - CASE WHEN l AND r AND s THEN 1 ELSE CAST(l AS INTEGER) + CAST(r AS INTEGER) END AS before FROM b),
g AS (SELECT frame, -1 AS i, frame AS s FROM f UNION ALL SELECT frame, i + 1, (s * 1664525 + 1013904223) % 4294967296 FROM g WHERE i < {2 * NOISE_BANDS * NOISE_WIDTH}),
n AS (SELECT frame, i // {NOISE_WIDTH} AS draw, i % {NOISE_WIDTH} AS j, x / sqrt(sum(x * x) OVER (PARTITION BY frame, i // {NOISE_WIDTH})) AS x FROM (SELECT frame, i, CAST(CASE WHEN s >= 2147483648 THEN s - 4294967296 ELSE s END AS DOUBLE) AS x FROM g WHERE i >= 0))
SELECT d.frame, CAST(d.band * {NOISE_WIDTH} + j.j AS INTEGER) AS line, round(CASE WHEN d.l THEN a.x ELSE 0 END, 6) AS x, round(CASE WHEN d.r THEN c.x ELSE 0 END, 6) AS y
FROM d CROSS JOIN (SELECT unnest(range(0, {NOISE_WIDTH})) AS j) j LEFT JOIN n a ON a.frame = d.frame AND a.draw = d.before AND a.j = j.j LEFT JOIN n c ON c.frame = d.frame AND c.j = j.j AND c.draw = d.before + CASE WHEN d.l AND NOT d.s THEN 1 ELSE 0 END""",
    ),
    "band_snr": (
        band_snr,
        duck("bands")
        + f""", r(bitrate) AS (VALUES {", ".join(f"({b})" for b in BITRATES)}), k AS (SELECT *, {RATE}.0 / {2 * LINES} AS hz FROM bands, r),
z AS (SELECT *, 13.3 * atan(start * hz * 0.00076) + 3.5 * pow(atan(start * hz * 4.0 / 3.0 * 0.0001), 2) AS z0, 13.3 * atan(stop * hz * 0.00076) + 3.5 * pow(atan(stop * hz * 4.0 / 3.0 * 0.0001), 2) AS z1,
  least(13.3 * atan({BORDERS[-1]} * hz * 0.00076) + 3.5 * pow(atan({BORDERS[-1]} * hz * 4.0 / 3.0 * 0.0001), 2), 24.0) / 25.0 AS share FROM k)
SELECT CAST(bitrate AS INTEGER) AS bitrate, band, round(greatest(0.003, least(0.8, 1.0 / greatest(1.0, pow(2.0, CAST(bitrate AS DOUBLE) / {RATE} * 1.18 * 0.024 * {LINES} / share * (z1 - z0) / greatest(stop - start, 1)) - 1.5))), 6) AS snr FROM z""",
    ),
    "short_overlap": (
        short_overlap,
        duck("spectra")
        + """, n AS (SELECT unnest(range(0, 128)) AS n), e AS (SELECT ch, frame, n, sum(CASE WHEN j BETWEEN 0 AND 15 THEN v * sin(pi() / 16 * (j + 0.5)) * cos(pi() / 8 * (j + 0.5 + 4) * (line % 8 + 0.5)) ELSE 0 END) AS y
  FROM (SELECT ch, frame, line, v, n, n - 28 - (line // 8) * 8 AS j FROM spectra, n) GROUP BY ch, frame, n),
h AS (SELECT ch, frame, n, y FROM e WHERE n < 64 UNION ALL SELECT ch, lead_frame, n - 64, y FROM (SELECT e.*, f.lead_frame FROM e JOIN (SELECT ch, frame, coalesce(lead(frame) OVER (PARTITION BY ch ORDER BY frame), frame + 1) AS lead_frame FROM (SELECT DISTINCT ch, frame FROM e)) f USING (ch, frame)) WHERE n >= 64)
SELECT ch, frame, CAST(n AS INTEGER) AS line, round(sum(y), 6) AS v FROM h GROUP BY ch, frame, n""",
    ),
    "switched_window": (
        switched_window,
        """WITH i AS (SELECT unnest(range(0, 128)) AS i), s(sequence) AS (VALUES ('long'), ('start'), ('stop'))
SELECT sequence, i, round(CASE
  WHEN sequence IN ('long', 'start') AND i < 64 THEN sin(pi() / 128 * (i + 0.5))
  WHEN sequence IN ('long', 'stop') AND i >= 64 THEN sin(pi() / 2 * pow(sin(pi() / 128 * (i + 0.5)), 2))
  WHEN sequence = 'start' THEN CASE WHEN i < 92 THEN 1 WHEN i < 100 THEN sin(pi() / 2 * pow(sin(pi() / 16 * (i - 92 + 8 + 0.5)), 2)) ELSE 0 END
  ELSE CASE WHEN i < 28 THEN 0 WHEN i < 36 THEN sin(pi() / 16 * (i - 28 + 0.5)) ELSE 1 END END, 9) AS w FROM i, s""",
    ),
    "one_band_gain": (
        one_band_gain,
        """SELECT p_partkey, round(CASE WHEN p_partkey % 11 <> 0 THEN pow(2.0, CASE WHEN (p_partkey % 256) >= 128 THEN -CAST(0.8 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END * ((p_partkey % 256) % 128) / 24.0) * CASE WHEN p_partkey % 3 <> 0 THEN pow(2.0, -(31.0 - p_partkey % 40) / 24.0) ELSE 1.0 END END, 6) AS gain FROM part""",
    ),
    "concealed_scales": (
        concealed_scales,
        """SELECT p_partkey, CAST(CASE WHEN k = 0 OR k = 12 THEN 0 WHEN k IN (14, 15) THEN -100 WHEN k = 13 THEN p_partkey % 256 - 246 + CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 90 ELSE 0 END ELSE p_partkey % 256 - 100 END AS INTEGER) AS scale
FROM (SELECT p_partkey, p_partkey % 32 AS k FROM part)""",
    ),
    "coupled_energy": (
        coupled_energy,
        """SELECT p_partkey, round(r * 128.0 * t / (r + 1), 4) AS left_energy, round(128.0 * t / (r + 1), 4) AS right_energy
FROM (SELECT p_partkey, pow(2.0, (p_partkey % 25) / CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 2.0 END - 12) AS r, pow(2.0, (p_partkey % 30) / CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 2.0 END) AS t FROM part)""",
    ),
    "band_offsets": (
        band_offsets,
        duck("spectra", "bands") + """ SELECT band, start, stop, stop - start AS width, count(*) AS n, CAST(min(line) AS INTEGER) AS "first", CAST(max(line) AS INTEGER) AS "last" FROM bands JOIN spectra ON line >= start AND line < stop GROUP BY band, start, stop""",
    ),
    "dequantize_lines": (
        dequantize_lines,
        duck("spectra") + f""", q AS (SELECT frame, ch, line, {_BAND} AS band, CAST(round(v * 20) AS INTEGER) AS q FROM spectra)
SELECT frame, ch, line, round(sign(q) * pow(abs(q), 4.0 / 3.0) * pow(2.0, (band * 3 - 10) / 4.0), 5) AS x FROM q""",
    ),
    "set_options": (
        set_options,
        _V + """ SELECT stream, t, v BETWEEN 10 AND 90 AS accepted, round(coalesce(last_value(CASE WHEN v BETWEEN 10 AND 90 THEN v END IGNORE NULLS) OVER (PARTITION BY stream ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 50), 6) AS setting FROM signal""",
    ),
}
