"""Queries on borders, upmixing, integer steps and variable thresholds; each oracle is written from the survey's wording."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import levels as L
from .spectral import MEASURES, _measures
from .views import duck, packets, spectra, table

QUALITY, STREAMS = 0.12, 4


def limiter_borders(spark, d):
    p = packets(spark, d)
    low = F.array_sort(F.collect_set("bytes"))
    patches = F.array_sort(F.collect_set(F.when(F.col("sub") % 3 == 1, F.col("bytes") + 1)))
    rows = p.groupBy("unit").agg(low.alias("low"), patches.alias("patches")).withColumn("patches", F.filter("patches", lambda b: (b > F.col("low")[0]) & (b < F.element_at("low", -1))))
    out = L.limiter_borders(F.col("low"), F.col("patches"), (F.col("unit") % 4).cast("int"))
    return rows.where(F.size("low") > 1).select("unit", F.array_join(F.transform(out, lambda b: b.cast("string")), ",").alias("borders"))


def upmix_band(spark, d):
    """Even lines are real parts, odd ones imaginary; the second channel is the decorrelated one."""
    at = lambda ch, part: F.max(F.when((F.col("ch") == ch) & (F.col("line") % 2 == part), F.col("v")))
    rows = spectra(spark, d).groupBy("frame", F.expr("line div 2").cast("int").alias("band")).agg(at(0, 0).alias("dr"), at(0, 1).alias("di"), at(1, 0).alias("wr"), at(1, 1).alias("wi")).where("dr is not null and wr is not null")
    f, b = F.col("frame"), F.col("band")
    phase = F.when(f % 3 != 0, (f * 5 + b) % 19)
    out = L.upmixed((F.col("dr"), F.col("di")), (F.col("wr"), F.col("wi")), (f + b) % 35 - 17, (f * 3 + b) % 10 - 1, phase)
    return rows.select("frame", "band", out.alias("o")).select("frame", "band", *[F.round(F.col(f"o.{c}"), 6).alias(c) for c in ("l_re", "l_im", "r_re", "r_im")])


def reflection(spark, d):
    p = F.col("p_partkey")
    bits = (F.expr("p_partkey % 4") + 2).cast("int")
    half = F.pow(F.lit(2.0), bits - 1)
    return table(spark, d, "part").select("p_partkey", F.round(L.reflection(bits, p % F.pow(F.lit(2.0), bits) - half), 6).alias("value"))


def integer_step(spark, d):
    p = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", L.integer_step((p * 2654435761 % 16383 - 8191).cast("int"), (p * 40503 % 260 - 160).cast("int")).alias("value"))


def variable_thresholds(spark, d):
    from ..operators.bands import masking

    rows = masking(_measures(spark, d)).withColumn("snr", 0.01 * (F.col("band") + 1)).withColumnRenamed("form_factor", "form")
    rows = rows.select((F.col("frame") % STREAMS).alias("stream"), F.expr(f"frame div {STREAMS}").alias("t"), "ch", "band", "width", "energy", "form", "threshold", "snr")
    out = L.variable_thresholds(rows, "stream", "t", QUALITY)
    return out.select("stream", "t", "ch", "band", F.round("chaos", 6).alias("chaos"), F.round("reduced", 6).alias("reduced"))


_DB = ", ".join(map(str, L.LEVELS_DB))
_LIKE = ", ".join(map(str, L.CORRELATIONS))
_QUARTERS = ", ".join(map(str, L.QUARTERS))

QUERIES = {
    "limiter_borders": (
        limiter_borders,
        duck("packets")
        + """, a AS (SELECT unit, list_sort(list(DISTINCT bytes)) AS low, list(DISTINCT bytes + 1) FILTER (WHERE sub % 3 = 1) AS pt FROM packets GROUP BY unit),
b AS (SELECT unit, low, list_filter(coalesce(pt, []), lambda v: v > low[1] AND v < low[-1]) || [low[-1]] AS k, [1.0, 1.2, 2.0, 3.0][unit % 4 + 1] AS dens FROM a WHERE len(low) > 1),
c AS (SELECT *, list_sort(list_distinct(low || k)) AS x FROM b)
SELECT unit, CASE WHEN unit % 4 = 0 THEN low[1] || ',' || low[-1] ELSE array_to_string(list_reduce(list_transform(x, lambda v: [v]), lambda s, v:
  CASE WHEN dens * log2(CAST(v[1] AS DOUBLE) / s[-1]) >= 0.49 THEN s || v WHEN NOT list_contains(k, v[1]) THEN s WHEN NOT list_contains(k, s[-1]) AND len(s) > 1 THEN s[:-2] || v ELSE s || v END), ',') END AS borders FROM c""",
    ),
    "upmix_band": (
        upmix_band,
        duck("spectra")
        + f""", a AS (SELECT frame, line // 2 AS band, max(v) FILTER (WHERE ch = 0 AND line % 2 = 0) AS dr, max(v) FILTER (WHERE ch = 0 AND line % 2 = 1) AS di, max(v) FILTER (WHERE ch = 1 AND line % 2 = 0) AS wr, max(v) FILTER (WHERE ch = 1 AND line % 2 = 1) AS wi FROM spectra GROUP BY frame, line // 2),
b AS (SELECT *, power(10, [{_DB}][CAST(least(greatest((frame + band) % 35 - 17, -15), 15) + 16 AS INTEGER)] / 10) AS q, [{_LIKE}][CAST(least(greatest((frame * 3 + band) % 10 - 1, 0), 7) + 1 AS INTEGER)] AS k, pi() / 8 * CASE WHEN frame % 3 <> 0 THEN (frame * 5 + band) % 19 & 15 ELSE 0 END AS w FROM a WHERE dr IS NOT NULL AND wr IS NOT NULL),
c AS (SELECT *, sqrt(q / (1 + q)) AS l, sqrt(1 / (1 + q)) AS r, sqrt((1 + k) * 0.5) AS g, sqrt((1 - k) * 0.5) AS u FROM b)
SELECT frame, CAST(band AS INTEGER) AS band, round(l * (g * dr + u * wr), 6) AS l_re, round(l * (g * di + u * wi), 6) AS l_im, round(r * ((g * dr - u * wr) * cos(w) - (g * di - u * wi) * sin(w)), 6) AS r_re, round(r * ((g * dr - u * wr) * sin(w) + (g * di - u * wi) * cos(w)), 6) AS r_im FROM c""",
    ),
    "reflection": (
        reflection,
        """SELECT p_partkey, round(CASE WHEN n NOT IN (3, 4) THEN 0.0 WHEN i < 0 THEN sin(i * pi() / ((1 << n) + 1)) ELSE sin(i * pi() / ((1 << n) - 1)) END, 6) AS value
FROM (SELECT p_partkey, CAST(p_partkey % 4 + 2 AS INTEGER) AS n, p_partkey % (1 << CAST(p_partkey % 4 + 2 AS INTEGER)) - (1 << CAST(p_partkey % 4 + 1 AS INTEGER)) AS i FROM part)""",
    ),
    "integer_step": (
        integer_step,
        f"""WITH a AS (SELECT p_partkey, CAST(p_partkey * 2654435761 % 16383 - 8191 AS HUGEINT) AS q, p_partkey * 40503 % 260 - 160 AS s FROM part),
b AS (SELECT *, q * q * q * q * 281474976710656 AS t, CAST(floor(cbrt(CAST(q * q * q * q AS DOUBLE)) * 65536) AS HUGEINT) AS g, CAST(floor(s / 4.0) AS INTEGER) - 1 AS up FROM a),
c AS (SELECT *, list_max(list_filter([g - 2, g - 1, g, g + 1, g + 2], lambda r: r * r * r <= t)) * [{_QUARTERS}][((s % 4) + 4) % 4 + 1] AS v FROM b),
e AS (SELECT *, least(CASE WHEN up >= 0 THEN v * (CAST(1 AS HUGEINT) << least(up, 40)) ELSE (v + (CAST(1 AS HUGEINT) << (-up - 1))) // (CAST(1 AS HUGEINT) << (-up)) END, 2147483647) AS o FROM c)
SELECT p_partkey, CAST(CASE WHEN q = 0 THEN 0 WHEN q < 0 THEN -o ELSE o END AS INTEGER) AS value FROM e""",
    ),
    "variable_thresholds": (
        variable_thresholds,
        MEASURES.replace("WITH ", "WITH RECURSIVE ", 1)
        + f""", m AS (SELECT frame % {STREAMS} AS stream, frame // {STREAMS} AS t, ch, band, width, energy, form_factor AS form, threshold, 0.01 * (band + 1) AS snr FROM masked),
c AS (SELECT stream, t, ch, sum(energy) AS every, coalesce(sum(energy) FILTER (WHERE energy > threshold), 0) AS e, coalesce(sum(form) FILTER (WHERE energy > threshold), 0) AS f, coalesce(sum(width) FILTER (WHERE energy > threshold), 0) AS n FROM m GROUP BY ALL),
f AS (SELECT stream, t, greatest(sum(every), 1e-10) AS total, least(1.0, sum(e * CASE WHEN n = 0 OR e <= 0 THEN 1 ELSE 4 * f / power(e / n, 0.25) / n END) / greatest(sum(every), 1e-10)) AS w, row_number() OVER (PARTITION BY stream ORDER BY t) AS k FROM c GROUP BY stream, t),
r AS (SELECT stream, k, t, total, least(w, 0.25 * w + 0.75 * 0.3) AS chaos FROM f WHERE k = 1 UNION ALL SELECT f.stream, f.k, f.t, f.total, least(w, 0.25 * w + 0.75 * r.chaos) FROM r JOIN f ON f.stream = r.stream AND f.k = r.k + 1),
z AS (SELECT m.*, chaos, power(power(threshold, 0.25) + {QUALITY} * least(1.0, greatest(0.1, 0.2 + 7.0 / 3.0 * (chaos - 0.2))) * power(total, 0.25), 4) AS up FROM m JOIN r USING (stream, t))
SELECT stream, t, ch, band, round(chaos, 6) AS chaos, round(CASE WHEN energy <= threshold OR energy <= 0 OR threshold < power(2, -33) THEN threshold WHEN up > energy * snr THEN greatest(energy * snr, threshold, power(2, -33)) ELSE greatest(up, power(2, -33)) END, 6) AS reduced FROM z""",
    ),
}
