"""Queries on ordered rows: recurrences, delays, gaps, gain curves, selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import gain as G
from ..operators import order as O
from ..operators import quant as Q
from ..operators import select as R
from .views import duck, packets, signal, table, vectors

ATTACK, RELEASE = 4, 20
FADE, FADE_OUT, FADE_IN = 0.70710677, 6, 5
NOMINAL, CAPACITY = 200, 450
#: Moves exact halves off the edge before rounding, in both engines.
TIE = 1e-9


def _loud(spark, d):
    return signal(spark, d).select("stream", "t", (F.col("v") / 50.0 - 1.0).alias("v"))


LOUD = duck("signal") + ", loud AS (SELECT stream, t, v / 50.0 - 1.0 AS v FROM signal)\n"


def _words(spark, d):
    kind = F.when(F.col("kind") == "click", "spectral").when(F.col("kind") == "view", "intensity").when(F.col("kind") == "error", "noise").otherwise("zero")
    return signal(spark, d).select("stream", "t", kind.alias("kind"), (F.floor("v") % 121).cast("long").alias("word"))


WORDS = duck("signal") + ", words AS (SELECT stream, t, CASE kind WHEN 'click' THEN 'spectral' WHEN 'view' THEN 'intensity' WHEN 'error' THEN 'noise' ELSE 'zero' END AS kind, CAST(floor(v) % 121 AS BIGINT) AS word FROM signal)\n"


def delta_decode(spark, d):
    return O.delta_decoded(_words(spark, d), 100).select("stream", "t", "value")


def delta_decode_single(spark, d):
    return O.running_total(_words(spark, d), 100).select("stream", "t", "value")


def run_length_expand(spark, d):
    rows = packets(spark, d).select(F.col("unit").alias("stream"), F.col("sub").alias("t"), (F.col("bytes") % 5).alias("code"), (F.col("bytes") % 4).alias("n"))
    return O.run_lengths(rows).select(F.col("stream").alias("unit"), "pos", "code")


def section_classes(spark, d):
    code = F.col("bytes") % 16
    kind = F.when(code == 0, "zero").when(code < 12, "spectral").when(code == 13, "noise").when(code >= 14, "intensity").otherwise("reserved")
    return packets(spark, d).groupBy("unit", kind.alias("kind")).agg(F.count("*").alias("n"), F.count_if(code != 0).alias("coded"))


def delay_line(spark, d):
    return O.delayed(signal(spark, d).select("stream", "t", "v"), 5).select("stream", "t", "delayed")


def delay_epochs(spark, d):
    rows = O.epochs(signal(spark, d).select("stream", "t", "v", "kind"), "kind")
    return O.delayed(rows, 1, F.col("epoch")).select("stream", "t", "epoch", "delayed")


def running_peak(spark, d):
    return O.running_peak(_loud(spark, d), ATTACK).select("stream", "t", F.round("peak", 9).alias("peak"))


def limiter(spark, d):
    return O.limited(_loud(spark, d), ATTACK, RELEASE).select("stream", "t", F.round("gain", 6).alias("gain"), F.round("limited", 6).alias("limited"))


def block_switch(spark, d):
    rows = signal(spark, d).select("stream", "t", (F.col("v") / 10.0).alias("ratio"))
    return O.block_states(rows, 10.0)


def onset(spark, d):
    return O.onsets(signal(spark, d).select("stream", "t", "v"), 2.5).select("stream", "t", F.round(F.col("level") + TIE, 4).alias("level"), "onset")


def _gappy(spark, d):
    return signal(spark, d).select("stream", "t", F.when(F.col("kind") != "error", F.col("v")).alias("v"))


GAPPY = duck("signal") + ", gappy AS (SELECT stream, t, CASE WHEN kind <> 'error' THEN v END AS v FROM signal)\n"


def conceal(spark, d):
    return O.concealed(_gappy(spark, d), FADE, FADE_OUT).select("stream", "t", F.round("v", 6).alias("v"), "lost")


def fade_in(spark, d):
    return O.recovered(_gappy(spark, d), FADE, FADE_IN).select("stream", "t", F.round("factor", 9).alias("factor"))


def reservoir(spark, d):
    return O.reservoir(packets(spark, d), NOMINAL, CAPACITY).select("unit", "sub", "fullness")


def alloc_bits(spark, d):
    return O.granted(O.reservoir(packets(spark, d), NOMINAL, CAPACITY), NOMINAL).select("unit", "sub", "granted")


def loss_estimate(spark, d):
    rows = packets(spark, d).select("unit", "sub", F.col("bytes").alias("distance"), F.lit(64).cast("long").alias("bits"))
    rows = rows.withColumn("distance", F.col("distance") * 1000)
    return O.losses(rows, 44100, 64000, 1024).select("unit", "sub", "lost")


def unit_stats(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("unit")).agg(
        F.sum(F.col("l_quantity").cast("long")).alias("bytes"),
        F.count("*").alias("units"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("long")).otherwise(0)).alias("bad_bytes"),
        F.count_if(F.col("l_returnflag") == "R").alias("bad_units"),
    )


def running_rate(spark, d):
    p = packets(spark, d)
    order = Window.partitionBy("unit").orderBy("sub")
    return p.select("unit", "sub", F.sum("bytes").over(order).cast("long").alias("so_far"), (F.col("bytes") - F.lag("bytes", 1, 0).over(order)).cast("long").alias("change"), F.round(F.sum("bits").over(order) * 44100.0 / (1024 * (F.col("sub") + 1)), 4).alias("rate"))


def config_epoch(spark, d):
    return O.epochs(signal(spark, d), "kind").select("stream", "t", "epoch")


def metadata_ttl(spark, d):
    return O.carried(signal(spark, d), "v", F.col("kind") == "purchase", 86400).select("stream", "t", "carried")


def metadata_merge(spark, d):
    known = F.last(F.when(F.col("kind") == "signup", F.col("v")), ignorenulls=True).over(O.so_far())
    return signal(spark, d).select("stream", "t", F.coalesce(known, F.lit(0.0)).alias("merged"), F.lag("kind", 2).over(O.in_stream()).alias("late_kind"))


def energy_between(spark, d):
    """Geometric mean of the neighbours' energies where a row is lost: a look-ahead of one row."""
    e = F.col("v") * F.col("v")
    rows = _gappy(spark, d).withColumns({"before": F.lag(e).over(O.in_stream()), "after": F.lead(e).over(O.in_stream())}).where("v is null")
    return rows.select("stream", "t", F.round(F.sqrt(F.coalesce("before", F.lit(0.0)) * F.coalesce("after", F.lit(0.0))), 4).alias("energy"))


def overlap_add(spark, d):
    return O.overlap_added(vectors(spark, d)).select("ch", "frame", "line", F.round("v", 9).alias("v"))


def _curve(spark, d):
    rows = signal(spark, d)
    nodes = rows.where("kind = 'purchase'").select("stream", "t", (F.col("v") / 100.0).alias("gain_db"), (F.col("v") / 1000.0 - 0.05).alias("slope"))
    return rows.select("stream", "t", "v"), nodes


def gain_linear(spark, d):
    return G.gain_at(*_curve(spark, d)).select("stream", "t", F.round(F.col("gain_db") + TIE, 6).alias("gain_db"))


def gain_hermite(spark, d):
    return G.gain_at(*_curve(spark, d), spline=True).select("stream", "t", F.round(F.col("gain_db") + TIE, 6).alias("gain_db"))


def gain_apply(spark, d):
    out = G.gain_at(*_curve(spark, d))
    return out.select("stream", "t", F.round(F.col("v") * F.pow(F.lit(10.0), F.col("gain_db") / 20.0), 4).alias("v"))


def section_dp(spark, d):
    costs = packets(spark, d).select("unit", "sub", (F.col("bytes") % 7).alias("c0"), (F.col("bytes") % 5 + 1).alias("c1"), (F.col("bytes") % 11).alias("c2"))
    return Q.section_costs(costs, ["c0", "c1", "c2"], 3)


RULES = ((0, 0, 1, 0, -40, -10, None), (1, 1, 2, 127, None, None, None), (2, 2, 3, 1, -63, -20, 1), (3, 3, 1, 1, None, None, None), (4, 4, 4, 127, -30, 0, 2), (5, 5, 1, 0, -40, -10, None))
RULE_NAMES = ("rule_id", "pos", "effect", "downmix_id", "lower", "upper", "depends_on")
LOUDNESS = ((0, 0, 0, 0, -23.0), (1, 0, 0, 127, -24.5), (2, 0, 1, 127, -18.0), (3, 0, 0, 0, -20.0), (4, 0, 2, 3, -16.0), (5, 1, 0, 127, -21.0), (6, 1, 1, 2, None), (7, 1, 1, 127, -19.5), (8, 1, 2, 1, -14.0))


def _requests(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(k.alias("request_id"), (k % 4).cast("int").alias("downmix_id"), (k % 6).cast("int").alias("effect"), (k % 2 == 0).alias("allow_dependent"), F.when(k % 5 != 0, -(k % 45)).cast("int").alias("loudness"), (k % 3).cast("int").alias("set_id"), F.expr("c_custkey div 3 % 2").cast("int").alias("album"))


def _typed(spark, rows, names, floats=()):
    kind = lambda n: "double" if n in floats else "int"
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).cast(kind(n)).alias(n) for v, n in zip(r, names, strict=True)]) for r in rows])))


def rule_select(spark, d):
    return R.best_rule(_requests(spark, d), _typed(spark, RULES, RULE_NAMES))


def loudness_select(spark, d):
    return R.loudness(_requests(spark, d).drop("loudness"), _typed(spark, LOUDNESS, ("pos", "album", "set_id", "downmix_id", "loudness"), ("loudness",)))


REQUESTS = """WITH requests AS (SELECT c_custkey AS request_id, c_custkey % 4 AS downmix_id, CAST(c_custkey % 6 AS INTEGER) AS effect, c_custkey % 2 = 0 AS allow_dependent,
  CASE WHEN c_custkey % 5 <> 0 THEN -(c_custkey % 45) END AS loudness, c_custkey % 3 AS set_id, c_custkey // 3 % 2 AS album FROM customer)"""
_null = lambda v: "NULL" if v is None else str(v)


def nearest_entry(spark, d):
    """The least table entry at or above a goal, else the last one; the greatest at or below it, else the first one."""
    entries = (3, 7, 12, 20, 31)
    p = table(spark, d, "part").select("p_partkey", "p_size")
    up = F.coalesce(*[F.when(F.lit(e) >= F.col("p_size"), e) for e in entries], F.lit(entries[-1]))
    down = F.coalesce(*[F.when(F.lit(e) <= F.col("p_size"), e) for e in reversed(entries)], F.lit(entries[0]))
    return p.select("p_partkey", up.alias("entry"), down.alias("below"))


GAIN_SQL = duck("signal") + """, nodes AS (SELECT stream, t, v / 100.0 AS g, v / 1000.0 - 0.05 AS s FROM signal WHERE kind = 'purchase'),
spans AS (SELECT s.stream, s.t, s.v, l.t AS lt, l.g AS lg, l.s AS ls, r.t AS rt, r.g AS rg, r.s AS rs FROM signal s
  ASOF LEFT JOIN nodes l ON l.stream = s.stream AND s.t > l.t ASOF LEFT JOIN nodes r ON r.stream = s.stream AND s.t <= r.t),
x AS (SELECT *, (t - lt) / CAST(greatest(rt - lt, 1) AS DOUBLE) AS x, CAST(greatest(rt - lt, 1) AS DOUBLE) AS w FROM spans),
lin AS (SELECT stream, t, v, coalesce(CASE WHEN lt IS NULL THEN rg WHEN rt IS NULL THEN lg ELSE lg + (rg - lg) * x END, 0) AS gain_db FROM x)
"""

QUERIES = {
    "delta_decode": (
        delta_decode,
        WORDS
        + """SELECT stream, t, CAST(CASE kind WHEN 'spectral' THEN sum(CASE WHEN kind = 'spectral' THEN word - 60 ELSE 0 END) OVER w + 100 - 100
  WHEN 'intensity' THEN sum(CASE WHEN kind = 'intensity' THEN word - 60 ELSE 0 END) OVER w - 100 WHEN 'noise' THEN word - 60 + 100 - 100 ELSE 0 END AS BIGINT) AS value
FROM words WINDOW w AS (PARTITION BY stream ORDER BY t)""",
    ),
    "delta_decode_single": (delta_decode_single, WORDS + "SELECT stream, t, CAST(100 + sum(CASE WHEN t = 0 THEN 0 ELSE word END) OVER (PARTITION BY stream ORDER BY t) AS BIGINT) AS value FROM words"),
    "run_length_expand": (
        run_length_expand,
        duck("packets")
        + """, r AS (SELECT unit, sub, bytes % 5 AS code, unnest(range(0, bytes % 4)) AS k FROM packets)
SELECT unit, CAST(row_number() OVER (PARTITION BY unit ORDER BY sub, k) - 1 AS BIGINT) AS pos, code FROM r""",
    ),
    "section_classes": (
        section_classes,
        duck("packets")
        + """SELECT unit, CASE WHEN bytes % 16 = 0 THEN 'zero' WHEN bytes % 16 < 12 THEN 'spectral' WHEN bytes % 16 = 13 THEN 'noise' WHEN bytes % 16 >= 14 THEN 'intensity' ELSE 'reserved' END AS kind,
  count(*) AS n, count(*) FILTER (WHERE bytes % 16 <> 0) AS coded FROM packets GROUP BY 1, 2""",
    ),
    "delay_line": (delay_line, duck("signal") + "SELECT stream, t, lag(v, 5, 0.0) OVER (PARTITION BY stream ORDER BY t) AS delayed FROM signal"),
    "delay_epochs": (
        delay_epochs,
        duck("signal")
        + """, c AS (SELECT *, CASE WHEN lag(kind) OVER w IS NULL OR lag(kind) OVER w = kind THEN 0 ELSE 1 END AS c FROM signal WINDOW w AS (PARTITION BY stream ORDER BY t)),
e AS (SELECT *, CAST(sum(c) OVER (PARTITION BY stream ORDER BY t) AS BIGINT) AS epoch FROM c)
SELECT stream, t, epoch, lag(v, 1, 0.0) OVER (PARTITION BY stream, epoch ORDER BY t) AS delayed FROM e""",
    ),
    "running_peak": (running_peak, LOUD + f"SELECT stream, t, round(greatest(1.0, max(abs(v)) OVER (PARTITION BY stream ORDER BY t ROWS BETWEEN {ATTACK} PRECEDING AND CURRENT ROW)), 9) AS peak FROM loud"),
    "limiter": (
        limiter,
        LOUD.replace("WITH ", "WITH RECURSIVE ")
        + f""", r AS (SELECT stream, t, 1.0 / greatest(1.0, max(abs(v)) OVER (PARTITION BY stream ORDER BY t ROWS BETWEEN {ATTACK} PRECEDING AND CURRENT ROW)) AS g,
  lag(v, {ATTACK}, 0.0) OVER (PARTITION BY stream ORDER BY t) AS late FROM loud),
c AS (SELECT stream, CAST(-1 AS BIGINT) AS t, CAST(1 AS DOUBLE) AS corr, CAST(1 AS DOUBLE) AS smooth, CAST(0 AS DOUBLE) AS late FROM (SELECT DISTINCT stream FROM loud)
UNION ALL SELECT stream, t, nc, CASE WHEN nc < smooth THEN greatest(pow(0.1, 1.0 / {ATTACK + 1}) * (smooth - nc) + nc, g) ELSE nc + pow(0.1, 1.0 / {RELEASE + 1}) * (smooth - nc) END, late
FROM (SELECT r.stream, r.t, r.g, c.smooth, r.late, CASE WHEN r.g < c.smooth THEN least(c.corr, (r.g - 0.1 * c.smooth) / 0.9) ELSE r.g END AS nc FROM c JOIN r ON r.stream = c.stream AND r.t = c.t + 1))
SELECT stream, t, round(smooth, 6) AS gain, round(greatest(-1.0, least(1.0, late * smooth)), 6) AS limited FROM c WHERE t >= 0""",
    ),
    "block_switch": (
        block_switch,
        duck("signal").replace("WITH ", "WITH RECURSIVE ")
        + """, c AS (SELECT DISTINCT stream, CAST(-1 AS BIGINT) AS t, 'long' AS state FROM signal
UNION ALL SELECT s.stream, s.t, CASE WHEN c.state = 'start' THEN 'short' WHEN c.state = 'short' THEN CASE WHEN s.v / 10.0 >= 10 THEN 'short' ELSE 'stop' END WHEN s.v / 10.0 >= 10 THEN 'start' ELSE 'long' END
FROM c JOIN signal s ON s.stream = c.stream AND s.t = c.t + 1) SELECT stream, t, state FROM c WHERE t >= 0""",
    ),
    "onset": (
        onset,
        duck("signal").replace("WITH ", "WITH RECURSIVE ")
        + """, c AS (SELECT DISTINCT stream, CAST(-1 AS BIGINT) AS t, CAST(0 AS DOUBLE) AS old, CAST(0 AS DOUBLE) AS level, CAST(0 AS DOUBLE) AS e FROM signal
UNION ALL SELECT s.stream, s.t, c.level, 0.7 * c.level + 0.3 * (s.v * s.v), s.v * s.v FROM c JOIN signal s ON s.stream = c.stream AND s.t = c.t + 1)
SELECT stream, t, round(old + 1e-9, 4) AS level, e > 2.5 * old AS onset FROM c WHERE t >= 0""",
    ),
    "conceal": (
        conceal,
        GAPPY
        + f""", g AS (SELECT *, last_value(v IGNORE NULLS) OVER w AS good, coalesce(last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER w, -1) AS seen FROM gappy WINDOW w AS (PARTITION BY stream ORDER BY t))
SELECT stream, t, round(coalesce(v, CASE WHEN t - seen > {FADE_OUT} THEN 0 ELSE coalesce(good, 0) * pow({FADE}, t - seen) END), 6) AS v, v IS NULL AS lost FROM g""",
    ),
    "fade_in": (
        fade_in,
        GAPPY
        + f""", g AS (SELECT *, t - coalesce(max(CASE WHEN v IS NOT NULL THEN t END) OVER (PARTITION BY stream ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) - 1 AS gap FROM gappy)
SELECT stream, t, round(CASE WHEN gap = 0 THEN 1 ELSE pow({FADE}, least(gap, {FADE_IN})) END, 9) AS factor FROM g WHERE v IS NOT NULL""",
    ),
    "reservoir": (
        reservoir,
        duck("packets").replace("WITH ", "WITH RECURSIVE ")
        + f""", c AS (SELECT DISTINCT unit, CAST(-1 AS BIGINT) AS sub, CAST(0 AS BIGINT) AS fullness FROM packets
UNION ALL SELECT p.unit, p.sub, least({CAPACITY}, c.fullness + {NOMINAL} - p.bits) FROM c JOIN packets p ON p.unit = c.unit AND p.sub = c.sub + 1) SELECT * FROM c WHERE sub >= 0""",
    ),
    "alloc_bits": (
        alloc_bits,
        duck("packets").replace("WITH ", "WITH RECURSIVE ")
        + f""", c AS (SELECT DISTINCT unit, CAST(-1 AS BIGINT) AS sub, CAST(0 AS BIGINT) AS fullness, CAST(0 AS BIGINT) AS granted FROM packets
UNION ALL SELECT p.unit, p.sub, least({CAPACITY}, c.fullness + {NOMINAL} - p.bits), least(p.bits, {NOMINAL} + c.fullness) FROM c JOIN packets p ON p.unit = c.unit AND p.sub = c.sub + 1) SELECT unit, sub, granted FROM c WHERE sub >= 0""",
    ),
    "loss_estimate": (
        loss_estimate,
        duck("packets")
        + """, n AS (SELECT unit, sub, 44100 * (bytes * 1000 + 64) AS n, 64000 * 1024 AS d FROM packets)
SELECT unit, sub, CAST(greatest(0, n // d - CASE WHEN d - n % d >= n % d THEN 1 ELSE 0 END) AS BIGINT) AS lost FROM n""",
    ),
    "unit_stats": (
        unit_stats,
        """SELECT l_orderkey AS unit, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes, count(*) AS units, CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS bad_bytes,
  count(*) FILTER (WHERE l_returnflag = 'R') AS bad_units FROM lineitem GROUP BY l_orderkey""",
    ),
    "running_rate": (
        running_rate,
        duck("packets")
        + """SELECT unit, sub, CAST(sum(bytes) OVER w AS BIGINT) AS so_far, bytes - lag(bytes, 1, 0) OVER w AS change, round(CAST(sum(bits) OVER w AS DOUBLE) * 44100.0 / (1024 * (sub + 1)), 4) AS rate
FROM packets WINDOW w AS (PARTITION BY unit ORDER BY sub)""",
    ),
    "config_epoch": (
        config_epoch,
        duck("signal")
        + """, c AS (SELECT *, CASE WHEN lag(kind) OVER w IS NULL OR lag(kind) OVER w = kind THEN 0 ELSE 1 END AS c FROM signal WINDOW w AS (PARTITION BY stream ORDER BY t))
SELECT stream, t, CAST(sum(c) OVER (PARTITION BY stream ORDER BY t) AS BIGINT) AS epoch FROM c""",
    ),
    "metadata_ttl": (
        metadata_ttl,
        duck("signal")
        + """, k AS (SELECT *, last_value(CASE WHEN kind = 'purchase' THEN v END IGNORE NULLS) OVER w AS kv, max(CASE WHEN kind = 'purchase' THEN ts END) OVER w AS kt FROM signal WINDOW w AS (PARTITION BY stream ORDER BY t))
SELECT stream, t, CASE WHEN epoch_us(ts) - epoch_us(kt) <= 86400000000 THEN kv END AS carried FROM k""",
    ),
    "metadata_merge": (
        metadata_merge,
        duck("signal")
        + """SELECT stream, t, coalesce(last_value(CASE WHEN kind = 'signup' THEN v END IGNORE NULLS) OVER w, 0.0) AS merged, lag(kind, 2) OVER (PARTITION BY stream ORDER BY t) AS late_kind
FROM signal WINDOW w AS (PARTITION BY stream ORDER BY t)""",
    ),
    "energy_between": (
        energy_between,
        GAPPY
        + """, n AS (SELECT *, lag(v * v) OVER w AS b, lead(v * v) OVER w AS a FROM gappy WINDOW w AS (PARTITION BY stream ORDER BY t))
SELECT stream, t, round(sqrt(coalesce(b, 0) * coalesce(a, 0)), 4) AS energy FROM n WHERE v IS NULL""",
    ),
    "overlap_add": (
        overlap_add,
        duck("spectra")
        + """, h AS (SELECT ch, frame, line, v FROM spectra WHERE line < 32 UNION ALL SELECT ch, nf, line - 32, v FROM
  (SELECT s.ch, coalesce((SELECT min(f.frame) FROM spectra f WHERE f.ch = s.ch AND f.frame > s.frame), s.frame + 1) AS nf, s.line, s.v FROM spectra s WHERE line >= 32))
SELECT ch, frame, line, round(sum(v), 9) AS v FROM h GROUP BY ch, frame, line""",
    ),
    "gain_linear": (gain_linear, GAIN_SQL + "SELECT stream, t, round(gain_db + 1e-9, 6) AS gain_db FROM lin"),
    "gain_hermite": (
        gain_hermite,
        GAIN_SQL
        + """SELECT stream, t, round(coalesce(CASE WHEN lt IS NULL THEN rg WHEN rt IS NULL THEN lg ELSE
  (2*x*x*x - 3*x*x + 1) * lg + (x*x*x - 2*x*x + x) * w * ls + (-2*x*x*x + 3*x*x) * rg + (x*x*x - x*x) * w * rs END, 0) + 1e-9, 6) AS gain_db FROM x""",
    ),
    "gain_apply": (gain_apply, GAIN_SQL + "SELECT stream, t, round(v * pow(10.0, gain_db / 20.0), 4) AS v FROM lin"),
    "section_dp": (
        section_dp,
        duck("packets").replace("WITH ", "WITH RECURSIVE ")
        + """, k AS (SELECT unit, sub, bytes % 7 AS c0, bytes % 5 + 1 AS c1, bytes % 11 AS c2 FROM packets),
c AS (SELECT unit, sub, 3 + c0 AS b0, 3 + c1 AS b1, 3 + c2 AS b2 FROM k WHERE sub = 0
UNION ALL SELECT k.unit, k.sub, least(b0, least(b0, b1, b2) + 3) + c0, least(b1, least(b0, b1, b2) + 3) + c1, least(b2, least(b0, b1, b2) + 3) + c2 FROM c JOIN k ON k.unit = c.unit AND k.sub = c.sub + 1)
SELECT unit, CAST(least(arg_max(b0, sub), arg_max(b1, sub), arg_max(b2, sub)) AS BIGINT) AS total FROM c GROUP BY unit""",
    ),
    "rule_select": (
        rule_select,
        REQUESTS + ", rules(" + ", ".join(RULE_NAMES) + ") AS (VALUES " + ", ".join("(" + ", ".join(map(_null, r)) + ")" for r in RULES) + """),
m AS (SELECT q.request_id, r.rule_id, row_number() OVER (PARTITION BY q.request_id ORDER BY CASE WHEN q.effect <> 0 AND r.effect & q.effect <> 0 THEN 1 ELSE 0 END DESC,
  CASE WHEN r.downmix_id = q.downmix_id THEN 1 ELSE 0 END DESC, CASE WHEN r.depends_on IS NULL THEN 1 ELSE 0 END DESC, r.pos DESC) AS n
  FROM requests q JOIN rules r ON (r.downmix_id = 127 OR r.downmix_id = q.downmix_id) AND (q.allow_dependent OR r.depends_on IS NULL)
  AND (q.loudness IS NULL OR (q.loudness >= coalesce(r.lower, -63) AND q.loudness <= coalesce(r.upper, 0))))
SELECT q.request_id, CAST(m.rule_id AS INTEGER) AS rule_id FROM requests q LEFT JOIN m ON m.request_id = q.request_id AND m.n = 1""",
    ),
    "loudness_select": (
        loudness_select,
        REQUESTS + ", e(pos, album, set_id, downmix_id, loudness) AS (VALUES " + ", ".join("(" + ", ".join(map(_null, r)) + ")" for r in LOUDNESS) + """)
SELECT request_id, CAST(coalesce((SELECT e.loudness FROM e WHERE e.album = q.album AND e.set_id = q.set_id AND e.downmix_id = q.downmix_id ORDER BY pos LIMIT 1),
  (SELECT e.loudness FROM e WHERE e.album = q.album AND e.set_id = q.set_id AND e.downmix_id = 127 ORDER BY pos LIMIT 1)) AS DOUBLE) AS loudness FROM requests q""",
    ),
    "nearest_entry": (nearest_entry, "SELECT p_partkey, coalesce((SELECT min(x) FROM (VALUES (3), (7), (12), (20), (31)) e(x) WHERE x >= p_size), 31) AS entry, coalesce((SELECT max(x) FROM (VALUES (3), (7), (12), (20), (31)) e(x) WHERE x <= p_size), 3) AS below FROM part"),
}
