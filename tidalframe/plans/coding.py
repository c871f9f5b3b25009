"""Queries on codes, deltas, segments and predictors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import coding as C
from ..operators import control as K
from ..operators import gain as G
from .ordered import GAIN_SQL, _curve
from .views import BORDERS, banded, duck, packets, signal, spectra, table, vectors

PLACES = 4
#: Books of a dimension and a largest level; a book's number is what each of its words costs besides the levels.
BOOKS = [(4, 1), (4, 2), (2, 4), (2, 12), (2, 8191), (3, 8191)]
CUT, BOOST = 0.5, 0.75
TAPS = 6
WIDEN = 0.9


def escape_values(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr("p_partkey * 2654435761 % 4294967296").alias("bits"), F.when(F.col("p_partkey") % 3 == 0, 16).when(F.col("p_partkey") % 3 == 1, -16).otherwise(F.col("p_partkey") % 13).cast("int").alias("q"))
    return p.select("p_partkey", C.escaped(F.col("q"), F.col("bits"), 32).alias("value"))


def bits_reversed(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", C.reversed_bits(F.expr("p_partkey * 2654435761 % 4294967296"), 40).alias("reversed"))


def side_data(spark, d):
    p = F.col("p_partkey")
    byte = lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")
    raw = F.concat(F.when(p % 7 == 0, "BD").otherwise("BC"), byte(F.lit(192) + p % 32), byte(p % 37), F.when(p % 37 >= 16, "55").otherwise(""), byte(F.lit(1) + F.when(p % 11 == 0, 1).otherwise(0)), byte(p % 256))
    rows = table(spark, d, "part").select("p_partkey", C.side_data(F.unhex(raw)).alias("s"))
    return rows.select("p_partkey", "s.mode", "s.value")


def layout_match(spark, d):
    p = packets(spark, d)
    kind = F.when(F.col("bytes") % 5 < 2, "single").when(F.col("bytes") % 5 < 4, "pair").otherwise("low")
    return C.layout_matches(p.select("unit", (F.col("unit") % 15).cast("int").alias("index"), kind.alias("kind")), "unit").select("unit", "channels", "matches")


def delta_modes(spark, d):
    s = signal(spark, d)
    row = F.expr(f"t div {PLACES}")
    rows = s.select("stream", row.alias("row"), (F.col("t") % PLACES).cast("int").alias("place"), (F.floor("v") % 9 - 4).alias("delta"), ((row * 7 + F.col("stream")) % 3 != 0).alias("in_time"))
    return C.reconstructed(rows, ["stream"], "row", "place").select("stream", "row", "place", F.col("value").cast("long").alias("value"))


def segment_grid(spark, d):
    p = packets(spark, d)
    rows = p.select("unit", F.col("sub").alias("section"), (F.col("bytes") % 5).alias("priority"), (F.col("bytes") % 4 + 1).cast("int").alias("words"), F.least(F.col("bytes") % 14, F.lit(11)).alias("width"))
    out = C.segments(rows, "unit", F.lit(60) + F.col("unit") % 40)
    return out.select("unit", "section", "word", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


def codebook_costs(spark, d):
    rows = banded(spectra(spark, d)).select("frame", "ch", "band", F.round(F.col("v") * 6).cast("int").alias("q"))
    return C.book_costs(rows, ["frame", "ch", "band"], BOOKS, K.code_bits(F.col("q").cast("double"), F.lit(1.0)))


def step_noise(spark, d):
    rows = vectors(spark, d).select("frame", "ch", F.transform("x", lambda v: F.round(v * 1.5)).alias("x"))
    out = C.step_noise(F.col("x"), (F.col("frame") % 10).cast("int"), F.col("frame") * 2 + F.col("ch"))
    return rows.select("frame", "ch", F.posexplode(out).alias("line", "v"))


def _pairs(x):
    return F.transform(F.slice(x, 1, TAPS), lambda v: F.cos(v))


def line_spectrum(spark, d):
    rows = vectors(spark, d).select("frame", "ch", F.posexplode(C.predictors(_pairs(F.col("x")))).alias("k", "a"))
    return rows.select("frame", "ch", "k", F.round("a", 6).alias("a"))


def shaped_lines(spark, d):
    """Each frame's lines from the predictor of the frame before to its own; the first one's is flat."""
    taps = F.transform(F.slice("x", 1, TAPS), lambda v: v * 0.3)
    rows = vectors(spark, d).withColumn("new", taps)
    rows = rows.withColumn("old", F.coalesce(F.lag("new").over(Window.partitionBy("ch").orderBy("frame")), F.transform("new", lambda _: F.lit(0.0))))
    out = rows.select("frame", "ch", F.posexplode(C.noise_shaped(F.col("x"), F.col("old"), F.col("new"))).alias("line", "v"))
    return out.select("frame", "ch", "line", F.round("v", 6).alias("v"))


def whitened_lines(spark, d):
    """Two channels as the parts of complex lines, each predicted along the frames."""
    re, im = F.max(F.when(F.col("ch") == 0, F.col("v"))), F.max(F.when(F.col("ch") == 1, F.col("v")))
    rows = spectra(spark, d).groupBy("frame", "line").agg(re.alias("re"), im.alias("im")).where("re is not null and im is not null")
    return C.whitened(rows, "line", "frame", WIDEN).select("frame", "line", F.round("wre", 6).alias("wre"), F.round("wim", 6).alias("wim"))


def gain_scaled(spark, d):
    """Gains from a curve, cuts and boosts scaled by their own shares, two sets one after the other."""
    out = G.gain_at(*_curve(spark, d))
    db = F.col("gain_db")
    both = F.when(db < 0, db * CUT).otherwise(db * BOOST) + F.when(F.col("t") % 2 == 0, -3.0 * CUT).otherwise(0.0)
    return out.select("stream", "t", F.round(F.col("v") * F.pow(F.lit(10.0), both / 20.0) + 1e-9, 4).alias("v"))


_BAND = "(" + " + ".join(f"CAST(line >= {b} AS INTEGER)" for b in BORDERS[1:-1]) + ")"
_TEXT = "lpad(bin(p_partkey * 2654435761 % 4294967296), 32, '0')"
_LIST = "(SELECT vec_id // 2 AS frame, CAST(vec_id % 2 AS INTEGER) AS ch, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL)"

QUERIES = {
    "escape_values": (
        escape_values,
        f"""WITH b AS (SELECT p_partkey, {_TEXT} AS s, length(regexp_extract({_TEXT}, '^1*')) AS ones, CASE p_partkey % 3 WHEN 0 THEN 16 WHEN 1 THEN -16 ELSE p_partkey % 13 END AS q FROM part)
SELECT p_partkey, CAST(CASE WHEN abs(q) <> 16 THEN q WHEN ones >= 9 THEN 8192 ELSE sign(q) * ((1 << (4 + ones)) + list_sum(list_transform(range(1, 5 + ones), lambda i: CAST(s[ones + 1 + i] AS INTEGER) << (4 + ones - i)))) END AS INTEGER) AS value FROM b""",
    ),
    "bits_reversed": (
        bits_reversed,
        "SELECT p_partkey, CAST(list_sum(list_transform(range(0, 40), lambda i: ((p_partkey * 2654435761 % 4294967296) >> i & 1) << (39 - i))) AS BIGINT) AS reversed FROM part",
    ),
    "side_data": (
        side_data,
        """SELECT p_partkey, CASE WHEN good THEN CAST((p_partkey % 32) // 4 % 4 AS INTEGER) END AS mode, CASE WHEN good THEN CAST(p_partkey % 256 AS INTEGER) END AS value FROM (
SELECT p_partkey, p_partkey % 7 <> 0 AND p_partkey % 32 % 2 = 0 AND p_partkey % 37 < 32 AND (p_partkey % 37) & 4 <> 0 AND p_partkey % 11 <> 0 AS good FROM part)""",
    ),
    "layout_match": (
        layout_match,
        duck("packets")
        + """, e AS (SELECT unit, unit % 15 AS i, count(*) FILTER (WHERE bytes % 5 < 2) AS s, count(*) FILTER (WHERE bytes % 5 IN (2, 3)) AS p, count(*) FILTER (WHERE bytes % 5 = 4) AS l FROM packets GROUP BY unit),
t(i, c, s, p, l) AS (VALUES """ + ", ".join(str((i, *row)) for i, row in enumerate(C.LAYOUTS) if i) + """)
SELECT e.unit, e.s + 2 * e.p + e.l AS channels, t.i IS NOT NULL AS matches FROM e LEFT JOIN t ON t.i = e.i AND t.s = e.s AND t.p = e.p AND t.l = e.l AND t.c = e.s + 2 * e.p + e.l""",
    ),
    "delta_modes": (
        delta_modes,
        duck("signal").replace("WITH ", "WITH RECURSIVE ")
        + f""", r AS (SELECT stream, t // {PLACES} AS row, list(CAST(floor(v) AS BIGINT) % 9 - 4 ORDER BY t) AS d FROM signal GROUP BY stream, t // {PLACES}),
c AS (SELECT DISTINCT stream, CAST(-1 AS BIGINT) AS row, [CAST(0 AS BIGINT), 0, 0, 0] AS x FROM r
UNION ALL SELECT r.stream, r.row, CASE WHEN (r.row * 7 + r.stream) % 3 <> 0 THEN list_transform(range(1, length(d) + 1), lambda i: d[i] + x[i]) ELSE list_transform(range(1, length(d) + 1), lambda i: CAST(list_sum(d[1:i]) AS BIGINT)) END
FROM c JOIN r ON r.stream = c.stream AND r.row = c.row + 1)
SELECT stream, row, CAST(i - 1 AS INTEGER) AS place, CAST(x[i] AS BIGINT) AS value FROM (SELECT stream, row, x, unnest(range(1, length(x) + 1)) AS i FROM c WHERE row >= 0)""",
    ),
    "segment_grid": (
        segment_grid,
        duck("packets")
        + """, w AS (SELECT unit, sub AS section, bytes % 5 AS p, least(bytes % 14, 11) AS width, 60 + unit % 40 AS budget, unnest(range(0, bytes % 4 + 1)) AS word FROM packets),
o AS (SELECT *, sum(width) OVER (PARTITION BY unit ORDER BY p DESC, section, word) AS stop FROM w WHERE p > 0 AND width > 0),
k AS (SELECT *, max(stop) OVER (PARTITION BY unit) AS final FROM o WHERE stop <= budget)
SELECT unit, section, CAST(word AS INTEGER) AS word, CAST(stop - width AS BIGINT) AS "first", CAST(CASE WHEN stop = final THEN budget ELSE stop END - 1 AS BIGINT) AS "last" FROM k""",
    ),
    "codebook_costs": (
        codebook_costs,
        duck("spectra")
        + f""", q AS (SELECT frame, ch, {_BAND} AS band, CAST(round(v * 6) AS INTEGER) AS q FROM spectra),
g AS (SELECT frame, ch, band, max(abs(q)) AS most, count(*) AS n, CAST(sum(CASE WHEN q = 0 THEN 1 ELSE 2 * length(bin(abs(q))) + 1 END) AS BIGINT) AS bits FROM q GROUP BY frame, ch, band)
SELECT frame, ch, band, CASE WHEN most = 0 THEN CAST(0 AS BIGINT) END AS c0, """
        + ", ".join(f"CASE WHEN n % {dim} = 0 AND most <= {top} THEN bits + n // {dim} * {i} END AS c{i}" for i, (dim, top) in enumerate(BOOKS, 1))
        + " FROM g",
    ),
    "step_noise": (
        step_noise,
        duck("spectra").replace("WITH ", "WITH RECURSIVE ")
        + """, q AS (SELECT frame, ch, line, round(v * 1.5) AS v, CASE WHEN line >= 10 THEN (line - 10) // 8 ELSE -1 END AS chunk FROM spectra),
z AS (SELECT *, chunk >= 0 AND max(abs(v)) OVER (PARTITION BY frame, ch, chunk) = 0 AS silent FROM q),
n AS (SELECT *, sum(CAST(silent AS INTEGER)) OVER (PARTITION BY frame, ch ORDER BY line) AS i FROM z),
g AS (SELECT DISTINCT frame, ch, 0 AS i, frame * 2 + ch AS s FROM spectra UNION ALL SELECT frame, ch, i + 1, (s * 69069 + 5) % 4294967296 FROM g WHERE i < 54)
SELECT n.frame, n.ch, n.line, CASE WHEN n.silent THEN CASE WHEN g.s & 65536 <> 0 THEN -1 ELSE 1 END * CAST(0.0625 AS DOUBLE) * (8 - least(n.frame % 10, 7)) ELSE n.v END AS v FROM n JOIN g ON g.frame = n.frame AND g.ch = n.ch AND g.i = n.i""",
    ),
    "line_spectrum": (
        line_spectrum,
        f"""WITH RECURSIVE e AS {_LIST}, p AS (SELECT frame, ch, list_transform(x[1:{TAPS}], lambda v: cos(v)) AS c FROM e),
m AS (SELECT frame, ch, c, 0 AS i, [CAST(1 AS DOUBLE), 1] AS a, [CAST(1 AS DOUBLE), -1] AS b FROM p
UNION ALL SELECT frame, ch, c, i + 1, list_transform(range(1, length(a) + 3), lambda k: coalesce(a[k], 0) - 2 * c[2 * i + 1] * CASE WHEN k > 1 THEN coalesce(a[k - 1], 0) ELSE 0 END + CASE WHEN k > 2 THEN coalesce(a[k - 2], 0) ELSE 0 END),
  list_transform(range(1, length(b) + 3), lambda k: coalesce(b[k], 0) - 2 * c[2 * i + 2] * CASE WHEN k > 1 THEN coalesce(b[k - 1], 0) ELSE 0 END + CASE WHEN k > 2 THEN coalesce(b[k - 2], 0) ELSE 0 END) FROM m WHERE i < {TAPS // 2})
SELECT frame, ch, CAST(k AS INTEGER) AS k, round(0.5 * (a[k + 2] + b[k + 2]), 6) AS a FROM (SELECT frame, ch, a, b, unnest(range(0, {TAPS})) AS k FROM m WHERE i = {TAPS // 2})""",
    ),
    "shaped_lines": (
        shaped_lines,
        f"""WITH RECURSIVE e AS {_LIST}, t AS (SELECT frame, ch, x, list_transform(x[1:{TAPS}], lambda v: v * 0.3) AS a FROM e),
l AS (SELECT *, coalesce(lag(a) OVER (PARTITION BY ch ORDER BY frame), list_transform(a, lambda v: CAST(0 AS DOUBLE))) AS o FROM t), n AS (SELECT frame, ch, x[i + 1] AS v, o, a, i FROM (SELECT *, unnest(range(0, 64)) AS i FROM l)),
h AS (SELECT frame, ch, i, v, 1 / greatest(sqrt(pow(1 + list_sum(list_transform(range(1, {TAPS + 1}), lambda k: pow(0.92, k) * o[k] * cos(pi() * i / 64 * k))), 2) + pow(list_sum(list_transform(range(1, {TAPS + 1}), lambda k: pow(0.92, k) * o[k] * sin(pi() * i / 64 * k))), 2)), 1e-9) AS before,
  1 / greatest(sqrt(pow(1 + list_sum(list_transform(range(1, {TAPS + 1}), lambda k: pow(0.92, k) * a[k] * cos(pi() * i / 64 * k))), 2) + pow(list_sum(list_transform(range(1, {TAPS + 1}), lambda k: pow(0.92, k) * a[k] * sin(pi() * i / 64 * k))), 2)), 1e-9) AS after FROM n),
r AS (SELECT DISTINCT frame, ch, CAST(-1 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS y FROM h
UNION ALL SELECT h.frame, h.ch, h.i, 2 * before * after / (before + after) * v + (after - before) / (before + after) * y FROM r JOIN h ON h.frame = r.frame AND h.ch = r.ch AND h.i = r.i + 1)
SELECT frame, ch, CAST(i AS INTEGER) AS line, round(y, 6) AS v FROM r WHERE i >= 0""",
    ),
    "whitened_lines": (
        whitened_lines,
        duck("spectra")
        + f""", z AS (SELECT frame, line, max(v) FILTER (WHERE ch = 0) AS re, max(v) FILTER (WHERE ch = 1) AS im FROM spectra GROUP BY frame, line),
l AS (SELECT *, lag(re) OVER w AS re1, lag(im) OVER w AS im1, lag(re, 2) OVER w AS re2, lag(im, 2) OVER w AS im2 FROM z WHERE re IS NOT NULL AND im IS NOT NULL WINDOW w AS (PARTITION BY line ORDER BY frame)),
s AS (SELECT line, sum(re1 * re1 + im1 * im1) AS e1, sum(re2 * re2 + im2 * im2) AS e2, sum(re1 * re2 + im1 * im2) AS cr, sum(im1 * re2 - re1 * im2) AS ci, sum(re * re1 + im * im1) AS pr, sum(im * re1 - re * im1) AS p_i,
  sum(re * re2 + im * im2) AS qr, sum(im * re2 - re * im2) AS qi FROM l WHERE re2 IS NOT NULL GROUP BY line),
d AS (SELECT *, e1 * e2 - cr * cr - ci * ci AS det FROM s),
a AS (SELECT line, det, (cr * qr + ci * qi - pr * e2) / det AS ar, (cr * qi - ci * qr - p_i * e2) / det AS ai, (cr * pr - ci * p_i - qr * e1) / det AS br, (cr * p_i + ci * pr - qi * e1) / det AS bi FROM d),
k AS (SELECT line, det > 1e-20 AND ar * ar + ai * ai < 16 AND br * br + bi * bi < 16 AS ok, ar, ai, br, bi FROM a)
SELECT frame, l.line, round(re + CASE WHEN ok THEN {WIDEN} * (ar * coalesce(re1, 0) - ai * coalesce(im1, 0)) + {WIDEN} * {WIDEN} * (br * coalesce(re2, 0) - bi * coalesce(im2, 0)) ELSE 0 END, 6) AS wre,
  round(im + CASE WHEN ok THEN {WIDEN} * (ar * coalesce(im1, 0) + ai * coalesce(re1, 0)) + {WIDEN} * {WIDEN} * (br * coalesce(im2, 0) + bi * coalesce(re2, 0)) ELSE 0 END, 6) AS wim FROM l JOIN k ON k.line = l.line""",
    ),
    "gain_scaled": (
        gain_scaled,
        GAIN_SQL + f"SELECT stream, t, round(v * pow(10, (CASE WHEN gain_db < 0 THEN gain_db * {CUT} ELSE gain_db * {BOOST} END + CASE WHEN t % 2 = 0 THEN -3.0 * {CUT} ELSE 0 END) / 20.0) + 1e-9, 4) AS v FROM lin",
    ),
}
