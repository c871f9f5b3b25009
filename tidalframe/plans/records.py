"""Queries on bit records; the oracles read the fields off the numbers that the records are made from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import records as R
from .views import blobs, spread, table

MOST_LONG, MOST_SHORT = 49, 14
BORDERS, LINES = tuple(range(0, 200, 4)), 256
CONFIG, UNIT = 40, 50
HASH = "p_partkey * 2654435761"


def _part(spark, d):
    return spread(table(spark, d, "part").select("p_partkey"), "p_partkey")


def _mod(k: int) -> Column:
    return F.col("p_partkey") % k


def _joined(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda v: v.cast("string")), ",")


def descriptor(spark, d):
    rows = _part(spark, d).select("p_partkey", R.descriptor(R.packed(R.field(F.expr(f"{HASH} % 65536"), 16))).alias("f"))
    again = F.when((F.col("coding") == 0) & F.col("err").isNull(), F.lower(F.hex(R.descriptor_bytes(F.col("sbr"), F.col("mode"), F.col("rate"), F.col("text"), F.col("enhanced"), F.col("coder"), F.col("reserved")))))
    return rows.select("p_partkey", "f.*").withColumn("again", again).drop("enhanced", "reserved")


def window_info(spark, d):
    rows = _part(spark, d).select("p_partkey", R.window_info(R.packed(R.field(F.expr(f"{HASH} % 65536"), 16)), MOST_LONG, MOST_SHORT).alias("f"))
    return rows.select("p_partkey", "f.*")


def pulse_fields(spark, d):
    more = F.when(_mod(5) == 0, "").otherwise(R.field(F.expr("(p_partkey * 40503 + 12345) % 16777216"), 24))
    data = R.packed(F.concat(R.field(F.expr(f"{HASH} % 16777216"), 24), more))
    rows = _part(spark, d).select("p_partkey", R.pulse_fields(data, _mod(7) == 0, 40 + _mod(10), BORDERS, LINES).alias("f"))
    return rows.select("p_partkey", "f.err", "f.start", _joined(F.col("f.places")).alias("places"), _joined(F.col("f.amplitudes")).alias("amplitudes"))


def reorder_lengths(spark, d):
    rows = _part(spark, d).select("p_partkey", R.reorder_lengths(R.packed(R.field(F.expr(f"{HASH} % 1048576"), 20)), _mod(2) == 1).alias("f"))
    return rows.select("p_partkey", "f.*")


def downmix_fields(spark, d):
    info = F.when(_mod(13) == 0, 130).otherwise(192 + _mod(32) * 2 + (_mod(9) == 0).cast("int"))
    made = [F.when(_mod(7) == 0, 189).otherwise(188), info, _mod(37), *[F.expr(f"(p_partkey * {37 * (k + 3)} + {k}) % 256") for k in range(13)]]
    data = F.substring(F.unhex(F.concat(*[F.lpad(F.hex(b.cast("long")), 2, "0") for b in made])), F.lit(1), (3 + _mod(14)).cast("int"))
    return _part(spark, d).select("p_partkey", R.downmix_fields(data).alias("f")).select("p_partkey", "f.*")


def metadata_bytes(spark, d):
    p = F.col("p_partkey")
    signed = lambda k: p * k % 2000000 - 1000000
    some = lambda c, v: F.when(c, v)
    m = {
        "surround": _mod(4), "mode": _mod(3), "center": some(_mod(3) != 0, _mod(8)), "around": some(_mod(3) != 0, _mod(7)), "gain": some(_mod(5) != 0, p * 7919 % 4000000 - 300000), "extended": _mod(2) == 1,
        "a": some(_mod(4) < 2, _mod(8)), "b": some(_mod(4) < 2, _mod(6)), "five": some(_mod(3) == 1, signed(104729)), "two": some(_mod(3) == 1, signed(1299709)), "low": some(_mod(5) == 2, _mod(16)),
    }
    return _part(spark, d).select("p_partkey", F.lower(F.hex(R.metadata_bytes(m))).alias("block"))


def replay_record(spark, d):
    """A document's first bytes as a configuration, the ones after it as units; some records are broken."""
    b, i = blobs(spark, d), F.col("blob_id")
    first = F.concat(F.unhex(F.when(i % 9 == 0, "00").otherwise("80")), F.substring("data", CONFIG + 1, UNIT))
    units = F.slice(F.array(first, *[F.substring("data", CONFIG + k * UNIT + 1, UNIT) for k in (1, 2)]), 1, (i % 4).cast("int"))
    data = F.concat(R.replay_bytes(F.substring("data", F.lit(1), (i % CONFIG).cast("int")), i % 2 == 1, units), F.unhex(F.when(i % 11 == 0, "01").otherwise("")))
    out = R.replay_units(b.select("blob_id", data.alias("record")), "record")
    return out.select("blob_id", "err", F.lower(F.hex("config")).alias("config"), "fade", F.size("units").alias("n"), F.lower(F.array_join(F.transform("units", lambda u: F.hex(u)), "")).alias("units")).withColumn("n", F.when(F.col("err").isNull(), F.col("n")))


def spatial_fields(spark, d):
    p = F.col("p_partkey")
    rate = F.when(_mod(16) == 15, R.field(p * 977 % 16777216, 24)).otherwise("")
    tree = F.when(_mod(11) == 0, 3).otherwise(R.TREE)
    head = [R.field(_mod(16), 4), rate, R.field(_mod(32), 5), R.field(_mod(8), 3), R.field(tree, 4), R.field(_mod(4), 2), R.field(_mod(2), 1), R.field(_mod(7), 3), R.field(F.expr("p_partkey div 16 % 4"), 2), R.field(F.expr("p_partkey div 3 % 4"), 2)]
    bits = F.concat(*head, F.when(F.expr("p_partkey div 16 % 4") == 2, R.field(_mod(2), 1)).otherwise(""))
    data = F.concat(R.packed(bits), F.unhex(F.repeat(F.lit("5a"), (_mod(4)).cast("int"))))
    data = F.when(_mod(13) == 0, F.substring(data, 1, 2)).otherwise(data)
    return _part(spark, d).select("p_partkey", R.spatial_fields(data).alias("f")).select("p_partkey", "f.*")


def range_payload(spark, d):
    p, seven = F.col("p_partkey"), lambda k: R.field(F.col("p_partkey") * k % 128, 7)
    mask = F.when(_mod(3) == 0, "0").when(_mod(3) == 1, F.concat(F.lit("1"), seven(37), F.lit("0"))).otherwise(F.concat(F.lit("1"), seven(41), F.lit("1"), seven(53), F.lit("0")))
    count = _mod(4)
    byte = lambda i, k: R.field((F.col("p_partkey") + i) * k % 256, 8)
    all_ = F.sequence(F.lit(0), count.cast("int"))
    several = F.when(count > 0, F.concat(F.lit("1"), R.field(count, 4), R.field(_mod(16), 4), F.array_join(F.transform(all_, lambda i: byte(i, 11)), ""))).otherwise("0")
    level = F.when(_mod(5) < 2, F.concat(F.lit("1"), R.field(_mod(128), 7), F.lit("0"))).otherwise("0")
    bits = F.concat(F.when(_mod(2) == 0, F.concat(F.lit("1"), R.field(_mod(16), 4), F.lit("0000"))).otherwise("0"), mask, several, level, F.array_join(F.transform(all_, lambda i: byte(i, 29)), ""))
    data = R.packed(bits)
    data = F.when(p % 17 == 0, F.substring(data, F.lit(1), F.length(data) - 1)).otherwise(data)
    out = _part(spark, d).select("p_partkey", R.range_payload(data).alias("f")).select("p_partkey", "f.*")
    return out.withColumns({"tops": _joined(F.col("tops")), "control": _joined(F.col("control"))})


def writer_options(spark, d):
    err = R.writer_error(_mod(3), F.expr("p_partkey div 3 % 6"), F.expr("p_partkey div 7 % 5"), _mod(2) == 1)
    return _part(spark, d).select("p_partkey", err.alias("err"))


def _list(n: Column, body) -> Column:
    """``body`` of 1 to ``n``; none of 0."""
    return F.transform(F.slice(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), 1, n.cast("int")), body)


def file_header(spark, d):
    """A file header of one program, written and read again; some are broken."""
    p = F.col("p_partkey")
    pair = lambda k: lambda i: F.struct(((p + i) % 2 == 1).alias("flag"), ((p * k + i) % 16).alias("tag"))
    tag = lambda k: lambda i: (p * k + i) % 16
    program = {
        "tag": _mod(16), "profile": _mod(4), "rate": _mod(16), "mono": F.when(_mod(3) == 0, _mod(16)), "stereo": F.when(_mod(4) == 0, _mod(15)), "matrix": F.when(_mod(5) == 0, _mod(8)),
        "front": _list(_mod(4), pair(1)), "side": _list(_mod(3), pair(3)), "back": _list(_mod(5), pair(5)), "coupled": _list(F.expr("p_partkey div 2 % 3"), pair(7)),
        "low": _list(F.expr("p_partkey div 4 % 4"), tag(9)), "associated": _list(F.expr("p_partkey div 5 % 3"), tag(11)),
    }
    comment = F.encode(F.col("p_name"), "utf-8")
    part = spread(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey")
    rows = part.select("p_partkey", R.file_header(F.when(_mod(2) == 1, F.encode(F.lit("abcdefghi"), "utf-8")), _mod(3) == 1, _mod(5) == 1, _mod(7) < 3, p * 7919 % (1 << 23), R.program_bits(program), comment).alias("data"))
    data = F.col("data")
    broken = F.when(_mod(19) == 0, F.concat(F.unhex(F.lit("42")), F.substring(data, 2, 1000))).when(_mod(23) == 0, F.substring(data, 1, 20)).otherwise(data)
    return R.file_fields(rows.select("p_partkey", broken.alias("data")), "data").drop("data")


def _num(s: str, first: int | str, n: int | str) -> str:
    """The number in ``n`` characters of a text of bits, in DuckDB."""
    return f"CAST(list_sum(list_transform(range(0, {n}), lambda z: CAST(substr({s}, CAST({first} + z + 1 AS BIGINT), 1) AS BIGINT) << CAST({n} - 1 - z AS BIGINT))) AS BIGINT)"


def _hex(s: str) -> str:
    """Hexadecimal digits of a text of bits, filled up to bytes."""
    return f"list_aggregate(list_transform(range(0, (length({s}) + 7) // 8 * 2), lambda y: substr('0123456789abcdef', 1 + CAST(list_sum(list_transform(range(0, 4), lambda z: CAST(substr(rpad({s}, CAST((length({s}) + 7) // 8 * 8 AS INTEGER), '0'), CAST(4 * y + z + 1 AS BIGINT), 1) AS BIGINT) << (3 - z))) AS BIGINT), 1)), 'string_agg', '')"


_FIELDS = "lpad(bin({v}), {n}, '0')"


def _f(v: str, n: int) -> str:
    return _FIELDS.format(v=v, n=n)


_RATES = ", ".join("NULL" if r is None else str(r) for r in R.PLAIN_RATES)
_EXTENDED = ", ".join(map(str, R.EXTENDED_RATES))
_BORDERS = ", ".join(map(str, BORDERS))
_SPATIAL = ", ".join(map(str, R.SPATIAL_RATES))
_RESOLUTIONS = ", ".join(map(str, R.RESOLUTIONS))
_RANGE = "CASE WHEN {g} < 0 THEN '1' ELSE '0' END || lpad(bin((abs({g}) + 8192) // 16384), 6, '0') || '0'"

QUERIES = {
    "descriptor": (
        descriptor,
        f"""WITH a AS (SELECT p_partkey, {HASH} % 65536 AS v FROM part),
b AS (SELECT *, v >> 14 AS coding, v >> 13 & 1 AS sb, v >> 11 & 3 AS mode, v >> 8 & 7 AS ri, v >> 7 & 1 AS tx, v >> 1 & 31 AS coder FROM a),
c AS (SELECT *, CASE WHEN coding = 3 THEN [{_EXTENDED}][ri + 1] ELSE [{_RATES}][ri + 1] END AS rate, coder >> 2 AS su FROM b),
e AS (SELECT *, CASE WHEN rate IS NULL THEN 'rate' WHEN coding = 0 AND mode = 3 OR coding = 3 AND mode % 2 = 1 THEN 'mode' WHEN coding = 0 AND mode = 1 AND sb = 0 THEN 'stereo' WHEN coding IN (0, 3) AND su NOT IN (0, 2, 3, 7) THEN 'surround' END AS err FROM c)
SELECT p_partkey, err, CAST(coding AS INTEGER) AS coding, sb = 1 AND coding <> 3 AS sbr, CAST(mode AS INTEGER) AS mode, CAST(rate AS INTEGER) AS rate, CASE WHEN coding IN (0, 3) AND mode = 2 THEN 2 ELSE 1 END AS channels,
  coding = 0 AND mode = 1 AS parametric, tx = 1 AS text, CAST(coder AS INTEGER) AS coder, coding = 0 AND su <> 0 AND mode <> 1 AS surround, CASE WHEN coding = 0 AND err IS NULL THEN lower(lpad(to_hex(v), 4, '0')) END AS again FROM e""",
    ),
    "window_info": (
        window_info,
        f"""WITH a AS (SELECT p_partkey, {HASH} % 65536 AS v FROM part), b AS (SELECT *, v >> 13 & 3 AS s, v >> 12 & 1 AS shape FROM a),
c AS (SELECT *, s <> 2 AS long, CASE WHEN s <> 2 THEN v >> 6 & 63 ELSE v >> 8 & 15 END AS top, CASE WHEN s <> 2 THEN 0 ELSE v >> 1 & 127 END AS g FROM b)
SELECT p_partkey, CASE WHEN top > CASE WHEN long THEN {MOST_LONG} ELSE {MOST_SHORT} END THEN 'bands' WHEN long AND (v >> 5 & 1) = 1 THEN 'prediction' END AS err, CAST(s AS INTEGER) AS sequence, CAST(shape AS INTEGER) AS shape, CAST(top AS INTEGER) AS bands,
  CAST(g AS INTEGER) AS grouping, CAST(CASE WHEN long THEN 1 ELSE 8 - bit_count(g) END AS INTEGER) AS groups, CASE WHEN long THEN 11 ELSE 15 END AS bits FROM c""",
    ),
    "pulse_fields": (
        pulse_fields,
        f"""WITH a AS (SELECT p_partkey AS p, {_f(f"{HASH} % 16777216", 24)} || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE {_f("(p_partkey * 40503 + 12345) % 16777216", 24)} END AS s FROM part),
b AS (SELECT *, {_num("s", 1, 2)} AS n, {_num("s", 3, 6)} AS start FROM a),
c AS (SELECT *, [{_BORDERS}][start + 1] AS first, CASE WHEN length(s) >= 18 + 9 * n THEN list_transform(range(0, n + 1), lambda i: {_num("s", "9 + 9 * i", 5)}) END AS o, CASE WHEN length(s) >= 18 + 9 * n THEN list_transform(range(0, n + 1), lambda i: {_num("s", "14 + 9 * i", 4)}) END AS m FROM b),
e AS (SELECT *, CASE WHEN s[1] = '0' THEN 'absent' WHEN p % 7 = 0 THEN 'window' WHEN start >= 40 + p % 10 THEN 'band' WHEN o IS NULL THEN 'short' WHEN first + list_sum(o) >= {LINES} THEN 'line' END AS err FROM c)
SELECT p AS p_partkey, err, CASE WHEN err IS NULL THEN CAST(start AS INTEGER) END AS start, CASE WHEN err IS NULL THEN array_to_string(list_transform(range(1, n + 2), lambda i: CAST(first + list_sum(o[1:i]) AS BIGINT)), ',') END AS places,
  CASE WHEN err IS NULL THEN array_to_string(m, ',') END AS amplitudes FROM e""",
    ),
    "reorder_lengths": (
        reorder_lengths,
        f"""SELECT p_partkey, CASE WHEN a > CASE p_partkey % 2 WHEN 1 THEN {R.REORDERED_TWO} ELSE {R.REORDERED_ONE} END THEN 'length' WHEN b > {R.LONGEST_WORD} THEN 'longest' WHEN a < b THEN 'order' END AS err, CAST(a AS INTEGER) AS length, CAST(b AS INTEGER) AS longest
FROM (SELECT p_partkey, {HASH} % 1048576 // 64 AS a, {HASH} % 64 AS b FROM part)""",
    ),
    "downmix_fields": (
        downmix_fields,
        """WITH a AS (SELECT p_partkey AS p, CASE WHEN p % 13 = 0 THEN 130 ELSE 192 + p % 32 * 2 + CASE WHEN p % 9 = 0 THEN 1 ELSE 0 END END AS info, p % 37 AS st FROM part),
b AS (SELECT *, ([CASE WHEN p % 7 = 0 THEN 189 ELSE 188 END, info, st] || list_transform(range(0, 13), lambda k: (p * 37 * (k + 3) + k) % 256))[1:3 + p % 14] AS x FROM a),
c AS (SELECT *, 4 + (st >> 4 & 1) + 2 * bit_count(st & 7) AS q FROM b), e AS (SELECT *, (st & 8) > 0 AS ext, x[q] AS more FROM c),
f AS (SELECT *, ext AND (more & 64) > 0 AS h6, ext AND (more & 32) > 0 AS h5, ext AND (more & 16) > 0 AS h4 FROM e),
g AS (SELECT *, q + 1 + CAST(h6 AS INTEGER) AS q5, q + 1 + CAST(h6 AS INTEGER) + 2 * CAST(h5 AS INTEGER) AS q4 FROM f),
h AS (SELECT *, p % 7 <> 0 AND p % 13 <> 0 AND info % 2 = 0 AND st < 32 AND ((st & 16) = 0 OR x[4] IS NOT NULL) AND (NOT ext OR more IS NOT NULL AND (NOT h6 OR x[q + 1] IS NOT NULL) AND (NOT h5 OR x[q5 + 1] IS NOT NULL) AND (NOT h4 OR x[q4] IS NOT NULL)) AS good FROM g)
SELECT p AS p_partkey, CASE WHEN good THEN (info & 2) > 0 END AS pseudo, CAST(CASE WHEN good AND (st & 16) > 0 AND x[4] >= 128 THEN x[4] >> 4 & 7 END AS INTEGER) AS center, CAST(CASE WHEN good AND (st & 16) > 0 AND (x[4] & 8) > 0 THEN x[4] & 7 END AS INTEGER) AS surround,
  CAST(CASE WHEN good AND h6 THEN x[q + 1] >> 5 END AS INTEGER) AS a, CAST(CASE WHEN good AND h6 THEN x[q + 1] >> 2 & 7 END AS INTEGER) AS b, CAST(CASE WHEN good AND h5 THEN x[q5] >> 1 END AS INTEGER) AS five, CAST(CASE WHEN good AND h5 THEN x[q5 + 1] >> 1 END AS INTEGER) AS two,
  CAST(CASE WHEN good AND h4 THEN x[q4] >> 4 END AS INTEGER) AS low FROM h""",
    ),
    "metadata_bytes": (
        metadata_bytes,
        f"""WITH a AS (SELECT p_partkey AS p, ((3156476 - (p * 7919 % 4000000 - 300000)) * 15 + 197283) // 394566 AS v, p * 104729 % 2000000 - 1000000 AS five, p * 1299709 % 2000000 - 1000000 AS two FROM part),
b AS (SELECT p, '10111100' || '11' || {_f("p % 4", 2)} || {_f("p % 3", 2)} || '00' || '000' || CASE WHEN p % 3 <> 0 THEN '1' ELSE '0' END || CASE WHEN p % 2 = 1 THEN '1' ELSE '0' END || CASE WHEN p % 5 <> 0 THEN '1' ELSE '0' END || '00'
  || CASE WHEN p % 3 <> 0 THEN '1' || {_f("p % 8", 3)} || '1' || {_f("p % 7", 3)} ELSE '' END
  || CASE WHEN p % 5 <> 0 THEN '00000001' || {_f("CASE WHEN v >= 240 THEN 255 WHEN v < 0 THEN 0 ELSE v // 15 * 16 + v % 15 END", 8)} ELSE '' END
  || CASE WHEN p % 2 = 1 THEN '0' || CASE WHEN p % 4 < 2 THEN '1' ELSE '0' END || CASE WHEN p % 3 = 1 THEN '1' ELSE '0' END || CASE WHEN p % 5 = 2 THEN '1' ELSE '0' END || '0000' || CASE WHEN p % 4 < 2 THEN {_f("p % 8", 3)} || {_f("p % 6", 3)} || '00' ELSE '' END
    || CASE WHEN p % 3 = 1 THEN {_RANGE.format(g="five")} || {_RANGE.format(g="two")} ELSE '' END || CASE WHEN p % 5 = 2 THEN {_f("p % 16", 4)} || '0000' ELSE '' END ELSE '' END AS s FROM a)
SELECT p AS p_partkey, {_hex("s")} AS block FROM b""",
    ),
    "replay_record": (
        replay_record,
        f"""WITH b AS (SELECT doc_id AS i, lower(hex(encode(text))) AS h, doc_id % 4 AS n FROM documents),
c AS (SELECT *, substr(h, {2 * CONFIG} + 1, {2 * UNIT}) AS u0, substr(h, {2 * CONFIG} + {2 * UNIT} + 1, {2 * UNIT}) AS u1, substr(h, {2 * CONFIG} + {4 * UNIT} + 1, {2 * UNIT}) AS u2 FROM b),
e AS (SELECT *, CASE WHEN n > 0 AND i % 9 = 0 THEN 'dependent' WHEN n > 1 AND u1 = '' OR n > 2 AND u2 = '' THEN 'empty' WHEN i % 11 = 0 THEN 'trailing' END AS err FROM c)
SELECT i AS blob_id, err, CASE WHEN err IS NULL THEN substr(h, 1, 2 * (i % {CONFIG})) END AS config, CASE WHEN err IS NULL THEN i % 2 = 1 END AS fade, CASE WHEN err IS NULL THEN CAST(n AS INTEGER) END AS n,
  CASE WHEN err IS NULL THEN CASE WHEN n > 0 THEN '80' || u0 ELSE '' END || CASE WHEN n > 1 THEN u1 ELSE '' END || CASE WHEN n > 2 THEN u2 ELSE '' END END AS units FROM e""",
    ),
    "spatial_fields": (
        spatial_fields,
        f"""WITH a AS (SELECT p_partkey AS p, p // 16 % 4 AS shape, p // 3 % 4 AS other FROM part),
e AS (SELECT *, CASE WHEN p % 16 IN (13, 14) THEN 'rate' WHEN p % 11 = 0 AND (p % 13 <> 0 OR p % 16 <> 15) THEN 'tree' WHEN p % 13 = 0 THEN 'short' WHEN shape > 2 THEN 'shape' WHEN other > 2 THEN 'decorrelation' END AS err FROM a)
SELECT p AS p_partkey, err, CASE WHEN err IS NULL THEN CAST(CASE WHEN p % 16 = 15 THEN p * 977 % 16777216 ELSE [{_SPATIAL}][p % 16 + 1] END AS INTEGER) END AS rate, CASE WHEN err IS NULL THEN CAST(p % 32 + 1 AS INTEGER) END AS slots,
  CASE WHEN err IS NULL THEN CAST([{_RESOLUTIONS}][p % 8 + 1] AS INTEGER) END AS resolution, CASE WHEN err IS NULL THEN CAST(p % 4 AS INTEGER) END AS quantiser, CASE WHEN err IS NULL THEN p % 2 = 1 END AS arbitrary, CASE WHEN err IS NULL THEN CAST(p % 7 AS INTEGER) END AS gain,
  CASE WHEN err IS NULL THEN CAST(shape AS INTEGER) END AS shape, CASE WHEN err IS NULL THEN CAST(other AS INTEGER) END AS decorrelation, CASE WHEN err IS NULL AND shape = 2 THEN p % 2 = 1 END AS envelope, CASE WHEN err IS NULL THEN CAST(p % 4 AS INTEGER) END AS more FROM e""",
    ),
    "range_payload": (
        range_payload,
        f"""WITH a AS (SELECT p_partkey AS p, p % 4 + 1 AS n FROM part)
SELECT p AS p_partkey, CAST(CASE WHEN good AND p % 2 = 0 THEN p % 16 END AS INTEGER) AS tag, CASE WHEN good THEN CASE p % 3 WHEN 0 THEN '' WHEN 1 THEN {_f("p * 37 % 128", 7)} ELSE {_f("p * 41 % 128", 7)} || {_f("p * 53 % 128", 7)} END END AS excluded,
  CAST(CASE WHEN good THEN CASE WHEN n > 1 THEN p % 16 ELSE 0 END END AS INTEGER) AS scheme, CASE WHEN good THEN CASE WHEN n > 1 THEN array_to_string(list_transform(range(0, n), lambda i: (p + i) * 11 % 256), ',') ELSE '255' END END AS tops,
  CAST(CASE WHEN good AND p % 5 < 2 THEN p % 128 END AS INTEGER) AS level, CASE WHEN good THEN array_to_string(list_transform(range(0, n), lambda i: (p + i) * 29 % 256), ',') END AS control FROM (SELECT *, p % 17 <> 0 AS good FROM a)""",
    ),
    "writer_options": (
        writer_options,
        "SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 AND p_partkey // 7 % 5 > 2 THEN 'signaling' WHEN p_partkey % 3 > 1 THEN 'version' WHEN p_partkey // 3 % 6 NOT IN (1, 2, 3, 4) THEN 'subframes' END AS err FROM part",
    ),
    "file_header": (
        file_header,
        """WITH a AS (SELECT p_partkey AS p, p_name, p % 4 AS nf, p % 3 AS ns, p % 5 AS nb, p // 2 % 3 AS nc, p // 4 % 4 AS nl, p // 5 % 3 AS nd FROM part),
b AS (SELECT *, list_transform(range(1, nf + 1), lambda i: (p + i) % 2 * 16 + (p + i) % 16) AS f, list_transform(range(1, ns + 1), lambda i: (p + i) % 2 * 16 + (p * 3 + i) % 16) AS s, list_transform(range(1, nb + 1), lambda i: (p + i) % 2 * 16 + (p * 5 + i) % 16) AS k,
  list_transform(range(1, nc + 1), lambda i: (p + i) % 2 * 16 + (p * 7 + i) % 16) AS c, list_transform(range(1, nl + 1), lambda i: (p * 9 + i) % 16) AS l, list_transform(range(1, nd + 1), lambda i: (p * 11 + i) % 16) AS q,
  33 + CASE WHEN p % 2 = 1 THEN 72 ELSE 0 END + 30 + CASE WHEN p % 7 < 3 THEN 0 ELSE 20 END + 31 + CASE WHEN p % 3 = 0 THEN 5 ELSE 1 END + CASE WHEN p % 4 = 0 THEN 5 ELSE 1 END + CASE WHEN p % 5 = 0 THEN 4 ELSE 1 END + 5 * (nf + ns + nb + nc) + 4 * (nl + nd) AS bits FROM a),
e AS (SELECT *, (bits + 7) // 8 + 1 + octet_length(encode(p_name)) AS total, CASE WHEN p % 19 = 0 THEN 'mark' WHEN p % 16 IN (13, 14) AND NOT (p % 23 = 0 AND p % 2 = 1 AND p % 7 >= 3) THEN 'rate' WHEN p % 23 = 0 AND (bits + 7) // 8 + 1 + octet_length(encode(p_name)) > 20 THEN 'short' END AS err FROM b)
SELECT p AS p_partkey, err, CASE WHEN err IS NULL THEN p % 3 = 1 END AS original, CASE WHEN err IS NULL THEN p % 5 = 1 END AS home, CASE WHEN err IS NULL THEN p % 7 < 3 END AS varies, CAST(CASE WHEN err IS NULL THEN p * 7919 % 8388608 END AS INTEGER) AS bitrate,
  CAST(CASE WHEN err IS NULL AND p % 3 = 0 THEN p % 16 END AS INTEGER) AS mono, CAST(CASE WHEN err IS NULL AND p % 4 = 0 THEN p % 15 END AS INTEGER) AS stereo, CAST(CASE WHEN err IS NULL AND p % 5 = 0 THEN p % 8 END AS INTEGER) AS matrix,
  CASE WHEN err IS NULL THEN array_to_string(f, ',') END AS front, CASE WHEN err IS NULL THEN array_to_string(s, ',') END AS side, CASE WHEN err IS NULL THEN array_to_string(k, ',') END AS back, CASE WHEN err IS NULL THEN array_to_string(l, ',') END AS low,
  CASE WHEN err IS NULL THEN array_to_string(q, ',') END AS associated, CASE WHEN err IS NULL THEN array_to_string(c, ',') END AS coupled,
  CAST(CASE WHEN err IS NULL THEN len(f) + len(s) + len(k) + coalesce(len(list_filter(f || s || k, lambda v: v >= 16)), 0) + nl END AS INTEGER) AS channels, CAST(CASE WHEN err IS NULL THEN total END AS INTEGER) AS stop FROM e""",
    ),
}
