"""Bit records as column expressions: writers, and readers whose later fields lie where earlier ones say.

Bits are read from the bytes around them, so positions may be columns. Nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the broadcast descriptor: rates by index (null: reserved) of the plain coders and of the extended one.
PLAIN_RATES = (8000, 12000, 16000, 24000, None, 48000, None, None)
EXTENDED_RATES = (9600, 12000, 16000, 19200, 24000, 32000, 38400, 48000)
#: Most bits that are reordered of one channel and of two, longest word.
REORDERED_ONE, REORDERED_TWO, LONGEST_WORD = 6144, 12288, 49
#: Fixed values of the replay record: widths of its escaped numbers, most units.
CONFIG_WIDTHS, COUNT_WIDTHS, UNIT_WIDTHS, MOST_UNITS, MOST_CONFIG = (4, 4, 8), (2, 4, 0), (16, 16, 0), 3, 512
#: Fixed values of the spatial record: rates and frequency resolutions by index, the one tree.
SPATIAL_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)
RESOLUTIONS, TREE = (0, 23, 15, 12, 9, 7, 5, 4), 7
#: Fixed values of the compression byte: offset, step and rounding of its scale of 15 steps.
GAIN_ZERO, GAIN_STEP, GAIN_HALF, GAIN_STEPS, GAIN_MOST = 3_156_476, 394_566, 197_283, 15, 240


def with_value(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def bits_of(data: Column) -> Column:
    """The bits of a binary value, most significant first."""
    starts = F.sequence(F.lit(1), F.length(data), F.lit(4))

    def piece(i: Column) -> Column:
        own = F.substring(data, i, F.lit(4))
        return F.lpad(F.bin(F.conv(F.hex(own), 16, 10).cast("long")), 8 * F.length(own), F.lit("0"))

    return F.when(F.length(data) > 0, F.array_join(F.transform(starts, piece), "")).when(F.length(data) == 0, "")


def packed(bits: Column) -> Column:
    """The bytes of a string of bits, filled up with zeros."""

    def whole(b: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(b), F.lit(32))
        pieces = F.transform(starts, lambda i: with_value(F.substring(b, i, F.lit(32)), lambda p: F.lpad(F.conv(p, 2, 16), (F.length(p) / 4).cast("int"), F.lit("0"))))
        return F.when(F.length(b) > 0, F.unhex(F.array_join(pieces, ""))).when(F.length(b) == 0, F.unhex(F.lit("")))

    return with_value(bits, lambda b: with_value(F.rpad(b, (F.ceil(F.length(b) / 8) * 8).cast("int"), F.lit("0")), whole))


def field(value: Column, n: int) -> Column:
    """``n`` bits of a number that isn't negative."""
    return F.lpad(F.bin(value.cast("long")), n, "0")


def number(data: Column, first: Column | int, n: Column | int) -> Column:
    """The number in ``n`` bits, 1 to 48, of a binary value from bit ``first`` on; null beyond the end."""
    first, n = (F.lit(v) if isinstance(v, int) else v for v in (first, n))
    seven = F.substring(data, F.shiftright(first, 3).cast("int") + 1, F.lit(7))  # dividing costs more where it is interpreted
    raw = F.conv(F.rpad(F.hex(seven), 14, F.lit("0")), 16, 10).cast("long")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int")) - 1
    return F.when(8 * F.length(data) >= first + n, F.call_function("shiftright", raw, (56 - first.bitwiseAND(F.lit(7)) - n).cast("int")).bitwiseAND(mask))


def byte_run(data: Column, first: Column, n: Column) -> Column:
    """``n`` bytes from bit ``first`` on."""
    own = bits_of(F.substring(data, F.floor(first / 8).cast("int") + 1, (n + 1).cast("int")))
    return packed(F.substring(own, (first % 8 + 1).cast("int"), (8 * n).cast("int")))


def _picked(values: tuple, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("int") for v in values]), index.cast("int"))


def escape_bits(value: Column, widths: tuple[int, int, int]) -> Column:
    """A number in as few fields as hold it: a field that is all ones goes on in the next one, which adds to it."""
    first, second, third = widths
    a, b = (1 << first) - 1, (1 << second) - 1
    tail = field(value - a, second)
    if third:
        tail = F.when(value - a >= b, F.concat(field(F.lit(b), second), field(value - a - b, third))).otherwise(tail)
    return F.when(value < a, field(value, first)).otherwise(F.concat(field(F.lit(a), first), tail))


def escape_number(data: Column, at: Column, widths: tuple[int, int, int]) -> Column:
    """(value, stop) of what ``escape_bits`` wrote at place ``at``; null beyond the end."""
    first, second, third = widths
    a, b = (1 << first) - 1, (1 << second) - 1
    one, two = number(data, at, first), number(data, at + first, second)
    made = lambda value, n: F.when(value.isNotNull(), F.struct(value.alias("value"), (at + n).cast("int").alias("stop")))
    out = F.when(one < a, made(one, first))
    if third:
        out = out.when((one == a) & (two == b), made(one + two + number(data, at + first + second, third), first + second + third))
    return out.when(one == a, made(one + two, first + second))


def descriptor(data: Column) -> Column:
    """The fields of a 16-bit descriptor of a broadcast stream, and err: null, ``short``, ``rate``, ``mode``, ``stereo`` or ``surround``."""

    def read(data: Column) -> Column:
        fields = {"coding": (0, 2), "sbr": (2, 1), "mode": (3, 2), "rate": (5, 3), "text": (8, 1), "enhanced": (9, 1), "coder": (10, 5), "reserved": (15, 1)}
        return with_value(F.struct(F.length(data).alias("bytes"), *[number(data, at, n).alias(k) for k, (at, n) in fields.items()]), judged)

    def judged(x: Column) -> Column:
        coding, sbr, mode, rate, coder = x["coding"], x["sbr"] == 1, x["mode"], x["rate"], x["coder"]
        plain, extended = coding == 0, coding == 3
        hertz = F.when(extended, _picked(EXTENDED_RATES, rate)).otherwise(_picked(PLAIN_RATES, rate))
        surround = F.shiftright(coder, 2)
        rows = F.when(x["bytes"] < 2, "short").when(hertz.isNull(), "rate").when((plain & (mode == 3)) | (extended & mode.isin(1, 3)), "mode")
        rows = rows.when(plain & (mode == 1) & ~sbr, "stereo").when((plain | extended) & ~surround.isin(0, 2, 3, 7), "surround")
        return F.struct(
            rows.alias("err"),
            coding.cast("int").alias("coding"),
            (sbr & ~extended).alias("sbr"),
            mode.cast("int").alias("mode"),
            hertz.alias("rate"),
            F.when((plain | extended) & (mode == 2), 2).otherwise(1).alias("channels"),
            (plain & (mode == 1)).alias("parametric"),
            (x["text"] == 1).alias("text"),
            (x["enhanced"] == 1).alias("enhanced"),
            coder.cast("int").alias("coder"),
            (x["reserved"] == 1).alias("reserved"),
            (plain & (surround != 0) & (mode != 1)).alias("surround"),
        )

    return with_value(data, read)


def descriptor_bytes(sbr: Column, mode: Column, rate: Column, text: Column, enhanced: Column, coder: Column, reserved: Column) -> Column:
    """The descriptor of a plain coder's stream of ``rate`` Hz; null for a rate that has no index."""
    index = F.array_position(F.array(*[F.coalesce(F.lit(r), F.lit(-1)) for r in PLAIN_RATES]), rate) - 1
    bit = lambda v: field(v.cast("int"), 1)
    return F.when(index >= 0, packed(F.concat(F.lit("00"), bit(sbr), field(mode, 2), field(index, 3), bit(text), bit(enhanced), field(coder, 5), bit(reserved))))


def window_info(data: Column, most_long: int, most_short: int) -> Column:
    """Window sequence, shape, bands and grouping at the start of ``data``; err is null, ``short``, ``bands`` or ``prediction``."""

    def read(data: Column) -> Column:
        sequence = number(data, 1, 2)
        long = sequence != 2
        top = F.when(long, number(data, 4, 6)).otherwise(number(data, 4, 4))
        grouping = F.when(long, F.lit(0)).otherwise(number(data, 8, 7))
        predicted = F.when(long, number(data, 10, 1))
        size = F.when(long, 11).otherwise(15)
        err = F.when(8 * F.length(data) < size, "short").when(top > F.when(long, most_long).otherwise(most_short), "bands").when(predicted == 1, "prediction")
        # A clear bit begins a group: as many groups as clear bits among the seven, and the first one.
        groups = F.when(long, 1).otherwise(8 - F.bit_count(grouping))
        return F.struct(err.alias("err"), sequence.cast("int").alias("sequence"), number(data, 3, 1).cast("int").alias("shape"), top.cast("int").alias("bands"), grouping.cast("int").alias("grouping"), groups.cast("int").alias("groups"), size.alias("bits"))

    return with_value(data, read)


def pulse_fields(data: Column, short: Column, bands: Column, borders: tuple[int, ...], lines: int) -> Column:
    """(err, start, places, amplitudes) of a pulse record; places are lines, each counted from the one before.

    err is null, ``absent``, ``window`` (pulses over short windows), ``band``, ``line`` or ``short``.
    """

    def read(data: Column) -> Column:
        count, start = number(data, 1, 2), number(data, 3, 6)
        all_ = F.sequence(F.lit(0), count.cast("int"))
        steps = F.transform(all_, lambda i: number(data, 9 + 9 * i, 5))
        places = F.transform(all_, lambda i: F.aggregate(F.slice(steps, 1, i + 1), _picked(borders, start).cast("long"), lambda a, s: a + s))
        sizes = F.transform(all_, lambda i: number(data, 14 + 9 * i, 4))
        err = F.when(number(data, 0, 1) == 0, "absent").when(short, "window").when(8 * F.length(data) < 9, "short").when((start >= bands) | (start >= len(borders)), "band")
        err = err.when(8 * F.length(data) < 18 + 9 * count, "short").when(F.element_at(places, -1) >= lines, "line")
        some = lambda v: F.when(err.isNull(), v)
        return F.struct(err.alias("err"), some(start.cast("int")).alias("start"), some(places).alias("places"), some(sizes).alias("amplitudes"))

    return with_value(data, read)


def reorder_lengths(data: Column, pair: Column) -> Column:
    """(err, length, longest): bits of a reordered section and of its longest word; err is null, ``short``, ``length``, ``longest`` or ``order``."""

    def read(data: Column) -> Column:
        length, longest = number(data, 0, 14), number(data, 14, 6)
        err = F.when(longest.isNull(), "short").when(length > F.when(pair, REORDERED_TWO).otherwise(REORDERED_ONE), "length").when(longest > LONGEST_WORD, "longest").when(length < longest, "order")
        return F.struct(err.alias("err"), length.cast("int").alias("length"), longest.cast("int").alias("longest"))

    return with_value(data, read)


def downmix_fields(data: Column) -> Column:
    """Mixing levels and gains of a side-data block, null if it is malformed or ends early; a level that isn't sent is null.

    Fixed values: a mark, two set bits and a clear one in the info byte, a status byte whose flags name the parts that follow.
    """

    def read(data: Column) -> Column:
        return with_value(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: number(data, 8 * i, 8)), placed)

    bit = lambda v, k: F.shiftright(v, k).bitwiseAND(F.lit(1))

    def placed(b: Column) -> Column:
        status = b[2]
        at = 3 + bit(status, 4) + 2 * (bit(status, 2) + bit(status, 1) + bit(status, 0))
        more = F.when(bit(status, 3) == 1, F.get(b, at.cast("int")))
        return with_value(F.struct(b.alias("b"), at.cast("int").alias("at"), more.alias("more")), made)

    def made(x: Column) -> Column:
        byte = lambda i: F.get(x["b"], i)
        info, status, at, more = x["b"][1], x["b"][2], x["at"], x["more"]
        good = (x["b"][0] == 0xBC) & (F.shiftright(info, 6) == 3) & (bit(info, 0) == 0) & (status < 32)
        levels = F.when(bit(status, 4) == 1, byte(F.lit(3)))
        has = lambda k: F.coalesce(bit(more, k) == 1, F.lit(False))
        ab = F.when(has(6), byte(at + 1))
        gains = at + 1 + has(6).cast("int")
        five, two = F.when(has(5), byte(gains)), F.when(has(5), byte(gains + 1))
        low = F.when(has(4), byte(gains + 2 * has(5).cast("int")))
        ended = ((bit(status, 4) == 1) & levels.isNull()) | ((bit(status, 3) == 1) & more.isNull()) | (has(6) & ab.isNull()) | (has(5) & two.isNull()) | (has(4) & low.isNull())
        part = lambda v, right, mask: F.shiftright(v, right).bitwiseAND(F.lit(mask)).cast("int")
        fields = F.struct(
            (bit(info, 1) == 1).alias("pseudo"),
            F.when(bit(levels, 7) == 1, part(levels, 4, 7)).alias("center"),
            F.when(bit(levels, 3) == 1, part(levels, 0, 7)).alias("surround"),
            part(ab, 5, 7).alias("a"),
            part(ab, 2, 7).alias("b"),
            part(five, 1, 127).alias("five"),
            part(two, 1, 127).alias("two"),
            part(low, 4, 15).alias("low"),
        )
        return F.when(good & ~ended, fields)

    return with_value(data, read)


def compression_byte(gain: Column) -> Column:
    """A gain in 16.16 dB as a byte of a coarse and a fine part, 255 at the least gains."""
    steps = F.floor(((F.lit(GAIN_ZERO) - gain) * GAIN_STEPS + GAIN_HALF) / GAIN_STEP)
    return F.when(steps >= GAIN_MOST, 255).when(steps < 0, 0).otherwise(F.floor(steps / GAIN_STEPS) * 16 + steps % GAIN_STEPS).cast("int")


def _range_bits(gain: Column) -> Column:
    """Sign, six bits of quarter dB (of a gain in 16.16) and a reserved bit."""
    size = F.shiftright((F.least(F.abs(gain), F.lit(127 << 14)) + (1 << 13)).cast("long"), 14).bitwiseAND(F.lit(63))
    return F.concat(F.when(gain < 0, "1").otherwise("0"), field(size, 6), F.lit("0"))


def metadata_bytes(m: dict[str, Column]) -> Column:
    """A side-data block from surround, mode, center, around (null: no levels), gain (null: none), and extended levels
    a, b (null: none), five, two (null: none) and low (null: none); ``extended`` says whether there is such a part."""
    flag = lambda c: F.when(c.isNotNull(), "1").otherwise("0")
    some = lambda c, bits: F.when(c, bits).otherwise("")
    extended = F.concat(
        F.lit("0"), flag(m["a"]), flag(m["five"]), flag(m["low"]), F.lit("0000"),
        some(m["a"].isNotNull(), F.concat(field(m["a"], 3), field(m["b"], 3), F.lit("00"))),
        some(m["five"].isNotNull(), F.concat(_range_bits(m["five"]), _range_bits(m["two"]))),
        some(m["low"].isNotNull(), F.concat(field(m["low"], 4), F.lit("0000"))),
    )
    head = F.concat(field(F.lit(0xBC), 8), F.lit("11"), field(m["surround"], 2), field(m["mode"], 2), F.lit("00"))
    status = F.concat(F.lit("000"), flag(m["center"]), F.when(m["extended"], "1").otherwise("0"), flag(m["gain"]), F.lit("00"))
    levels = some(m["center"].isNotNull(), F.concat(F.lit("1"), field(m["center"], 3), F.lit("1"), field(m["around"], 3)))
    gain = some(m["gain"].isNotNull(), F.concat(field(F.lit(1), 8), field(compression_byte(m["gain"]), 8)))
    return packed(F.concat(head, status, levels, gain, some(m["extended"], extended)))


def replay_bytes(config: Column, fade: Column, units: Column) -> Column:
    """A replay record: a configuration, a flag and an array of up to three units, lengths escaped."""
    one = lambda u: F.concat(escape_bits(F.length(u), UNIT_WIDTHS), bits_of(u))
    return packed(F.concat(escape_bits(F.length(config), CONFIG_WIDTHS), bits_of(config), F.when(fade, "1").otherwise("0"), F.lit("0"), escape_bits(F.size(units), COUNT_WIDTHS), F.array_join(F.transform(units, one), "")))


def replay_units(df: DataFrame, data: str) -> DataFrame:
    """``df`` with config, fade and units of the replay record in column ``data``, and err.

    err is null, ``short``, ``config``, ``count``, ``empty`` (a unit without bytes), ``dependent`` (a first unit that
    can't be decoded by itself) or ``trailing`` (bits that aren't zero after the last unit).
    """
    raw = F.col(data)
    out = df.withColumn("__c", escape_number(raw, F.lit(0), CONFIG_WIDTHS))
    out = out.withColumn("__at", (F.col("__c.stop") + 8 * F.col("__c.value")).cast("int"))
    out = out.withColumn("__n", escape_number(raw, F.col("__at") + 2, COUNT_WIDTHS)).withColumn("__to0", F.col("__n.stop"))
    for k in range(MOST_UNITS):
        out = out.withColumn(f"__u{k}", F.when(F.col("__n.value") > k, escape_number(raw, F.col(f"__to{k}"), UNIT_WIDTHS)))
        out = out.withColumn(f"__to{k + 1}", F.when(F.col("__n.value") > k, F.col(f"__u{k}.stop") + 8 * F.col(f"__u{k}.value")).otherwise(F.col(f"__to{k}")).cast("int"))
    cut = lambda first, n: byte_run(raw, first, n)
    err = F.when(F.col("__c").isNull(), "short").when(F.col("__c.value") > MOST_CONFIG, "config").when(F.col("__n").isNull(), "short").when(F.col("__n.value") > MOST_UNITS, "count")
    for k in range(MOST_UNITS):
        mine = F.col("__n.value") > k
        err = err.when(mine & (F.col(f"__u{k}.value") == 0), "empty").when(mine & (F.col(f"__u{k}").isNull() | (8 * F.length(raw) < F.col(f"__to{k + 1}"))), "short")
        if not k:
            err = err.when(mine & (number(raw, F.col("__u0.stop"), 1) == 0), "dependent")
    stop = F.col(f"__to{MOST_UNITS}")
    rest = F.coalesce(number(raw, stop, F.when(stop % 8 > 0, 8 - stop % 8).otherwise(8)), F.lit(0)) != 0
    err = err.when(rest | F.hex(F.substring(raw, F.floor(stop / 8).cast("int") + 2, F.length(raw))).rlike("[^0]"), "trailing")
    out = out.withColumn("err", err)
    units = F.filter(F.array(*[F.when(F.col("__n.value") > k, cut(F.col(f"__u{k}.stop"), F.col(f"__u{k}.value").cast("int"))) for k in range(MOST_UNITS)]), lambda u: u.isNotNull())
    good = F.col("err").isNull()
    return out.select(
        *[F.col(c) for c in df.columns], "err",
        F.when(good, cut(F.col("__c.stop"), F.col("__c.value").cast("int"))).alias("config"),
        F.when(good, number(raw, F.col("__at"), 1) == 1).alias("fade"),
        F.when(good, units).alias("units"),
    )


def spatial_fields(data: Column) -> Column:
    """A spatial record's fields, and err: null, ``short``, ``rate``, ``tree``, ``shape`` or ``decorrelation``."""

    def read(data: Column) -> Column:
        index = number(data, 0, 4)
        return with_value(F.struct(index.alias("index"), F.when(index == 15, 28).otherwise(4).alias("at")), lambda h: with_value(fields(data, h), judged))

    def fields(data: Column, h: Column) -> Column:
        places = {"slots": (0, 5), "resolution": (5, 3), "tree": (8, 4), "quantiser": (12, 2), "arbitrary": (14, 1), "gain": (15, 3), "shape": (18, 2), "other": (20, 2), "envelope": (22, 1)}
        rate = F.when(h["index"] == 15, number(data, 4, 24).cast("int")).otherwise(_picked(SPATIAL_RATES, h["index"]))
        return F.struct(h["index"].alias("index"), h["at"].alias("at"), (8 * F.length(data)).alias("bits"), rate.alias("rate"), *[number(data, h["at"] + off, n).alias(k) for k, (off, n) in places.items()])

    def judged(x: Column) -> Column:
        at, shape, other, rate = x["at"], x["shape"], x["other"], x["rate"]
        stop = at + 22 + (shape == 2).cast("int")
        err = F.when(x["index"].isin(13, 14), "rate").when(x["tree"] != TREE, "tree").when(shape > 2, "shape").when(other > 2, "decorrelation").when(F.coalesce(x["bits"] < stop, F.lit(True)), "short")
        some = lambda v: F.when(err.isNull(), v)
        rest = (x["bits"] - F.ceil(stop / 8) * 8) / 8
        return F.struct(
            err.alias("err"), some(rate).alias("rate"), some((x["slots"] + 1).cast("int")).alias("slots"), some(_picked(RESOLUTIONS, x["resolution"])).alias("resolution"),
            some(x["quantiser"].cast("int")).alias("quantiser"), some(x["arbitrary"] == 1).alias("arbitrary"), some(x["gain"].cast("int")).alias("gain"), some(shape.cast("int")).alias("shape"),
            some(other.cast("int")).alias("decorrelation"), some(F.when(shape == 2, x["envelope"] == 1)).alias("envelope"), some(rest.cast("int")).alias("more"),
        )

    return with_value(data, read)


def range_payload(data: Column) -> Column:
    """An in-band range-control record: tag, channels left out, scheme, band tops, reference level and control bytes; null beyond the end.

    The channels come in sevens, each followed by a bit that says whether more do.
    """

    def read(data: Column) -> Column:
        at0 = F.when(number(data, 0, 1) == 1, 9).otherwise(1)

        def masked(start: Column) -> Column:
            some = number(data, start, 1) == 1
            mask = F.when(some, F.regexp_extract(F.substring(bits_of(data), start + 2, 8 * F.length(data)), "^(?:[01]{7}1)*[01]{7}0", 0)).otherwise("")
            return with_value(F.struct(mask.alias("m"), some.alias("some"), start.alias("start")), placed)

        def placed(x: Column) -> Column:
            to = (x["start"] + 1 + F.length(x["m"])).cast("int")
            return with_value(F.struct(x["m"].alias("m"), (x["some"] & (x["m"] == "")).alias("lost"), to.alias("to"), (number(data, to, 1) == 1).alias("many")), banded)

        def banded(x: Column) -> Column:
            count = F.when(x["many"], number(data, x["to"] + 1, 4) + 1).otherwise(1)
            scheme = F.when(x["many"], number(data, x["to"] + 5, 4)).otherwise(0)
            made = F.struct(x["m"].alias("m"), x["lost"].alias("lost"), count.cast("int").alias("n"), scheme.cast("int").alias("scheme"), (x["to"] + F.when(x["many"], 9).otherwise(1)).alias("tops"))
            return with_value(made, leveled)

        def leveled(x: Column) -> Column:
            to = x["tops"] + F.when(x["n"] > 1, 8 * x["n"]).otherwise(0)
            return with_value(F.struct(x["m"].alias("m"), x["lost"].alias("lost"), x["n"].alias("n"), x["scheme"].alias("scheme"), x["tops"].alias("tops"), to.alias("to"), (number(data, to, 1) == 1).alias("level")), ended)

        def ended(x: Column) -> Column:
            first = x["to"] + F.when(x["level"], 9).otherwise(1)
            each = F.sequence(F.lit(0), x["n"] - 1)
            tops = F.when(x["n"] > 1, F.transform(each, lambda i: number(data, (x["tops"] + 8 * i).cast("int"), 8).cast("int"))).otherwise(F.array(F.lit(255)))
            out = F.regexp_replace(x["m"], "(.{7}).", "$1")
            made = F.struct(
                F.when(number(data, 0, 1) == 1, number(data, 1, 4).cast("int")).alias("tag"), out.alias("excluded"), x["scheme"].alias("scheme"), tops.alias("tops"),
                F.when(x["level"], number(data, x["to"] + 1, 7).cast("int")).alias("level"), F.transform(each, lambda i: number(data, first + 8 * i, 8).cast("int")).alias("control"),
            )
            return F.when(~x["lost"] & (8 * F.length(data) >= first + 8 * x["n"]), made)

        return with_value(at0, masked)

    return with_value(data, read)


def writer_error(version: Column, subframes: Column, signaling: Column, extended: Column) -> Column:
    """What is wrong with a writer's options: null, ``signaling``, ``version`` or ``subframes``."""
    return F.when(extended & (signaling > 2), "signaling").when(version > 1, "version").when(~subframes.between(1, 4), "subframes")


def program_bits(p: dict[str, Column]) -> Column:
    """A program's layout without its comment: tag, profile, rate, mono, stereo, matrix (null: none), and the arrays front,
    side, back and coupled of (flag, tag), low and associated of tags."""
    size = lambda name, n: field(F.size(p[name]), n)
    pairs = lambda name: F.array_join(F.transform(p[name], lambda e: F.concat(F.when(e["flag"], "1").otherwise("0"), field(e["tag"], 4))), "")
    tags = lambda name: F.array_join(F.transform(p[name], lambda t: field(t, 4)), "")
    some = lambda name, n: F.when(p[name].isNotNull(), F.concat(F.lit("1"), field(p[name], n))).otherwise("0")
    return F.concat(
        field(p["tag"], 4), field(p["profile"], 2), field(p["rate"], 4), size("front", 4), size("side", 4), size("back", 4), size("low", 2), size("associated", 3), size("coupled", 4),
        some("mono", 4), some("stereo", 4), some("matrix", 3), pairs("front"), pairs("side"), pairs("back"), tags("low"), tags("associated"), pairs("coupled"),
    )


def file_header(mark: Column, original: Column, home: Column, varies: Column, bitrate: Column, program: Column, comment: Column) -> Column:
    """A file's header of one program (``program_bits``) and a binary comment of up to 255 bytes; null if the bit rate or the comment is too large.

    ``mark`` is null or nine bytes. Fixed values: the four letters at the start, 23 bits of rate, 20 of fullness.
    """
    bit = lambda v: F.when(v, "1").otherwise("0")
    head = F.concat(
        F.lit("".join(f"{b:08b}" for b in b"ADIF")), F.coalesce(F.concat(F.lit("1"), bits_of(mark)), F.lit("0")), bit(original), bit(home), bit(varies), field(bitrate, 23), F.lit("0000"),
        F.when(varies, "").otherwise("0" * 20), program,
    )
    return F.when((bitrate < 1 << 23) & (F.length(comment) < 256), F.concat(packed(head), F.unhex(F.lpad(F.hex(F.length(comment).cast("long")), 2, "0")), comment))


def _numbers(data: Column, first: Column, count: Column, n: int) -> Column:
    """``count`` numbers of ``n`` bits each, one after the other."""
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: number(data, (first + n * i).cast("int"), n).cast("int"))


def file_fields(df: DataFrame, data: str) -> DataFrame:
    """``df`` with the fields of the file header in column ``data``, of one program, and stop, its length in bytes; err is null, ``mark``, ``programs``, ``rate`` or ``short``."""
    raw, c = F.col(data), F.col
    take = lambda first, n: number(raw, first, n)
    out = df.withColumn("__a", F.when(take(32, 1) == 1, 105).otherwise(33))
    out = out.withColumn("__p", c("__a") + 30 + F.when(take(c("__a") + 2, 1) == 1, 0).otherwise(20))
    sizes = {"front": (10, 4), "side": (14, 4), "back": (18, 4), "low": (22, 2), "associated": (24, 3), "coupled": (27, 4)}
    out = out.withColumns({f"__n_{k}": take(c("__p") + at, n).cast("int") for k, (at, n) in sizes.items()})
    out, at = out.withColumn("__at0", c("__p") + 31), 0
    for k, n in (("mono", 4), ("stereo", 4), ("matrix", 3)):
        here = c(f"__at{at}")
        out = out.withColumns({f"__{k}": F.when(take(here, 1) == 1, take(here + 1, n).cast("int")), f"__at{at + 1}": here + F.when(take(here, 1) == 1, n + 1).otherwise(1)})
        at += 1
    for k, n in (("front", 5), ("side", 5), ("back", 5), ("low", 4), ("associated", 4), ("coupled", 5)):
        here, size = c(f"__at{at}"), c(f"__n_{k}")
        each = F.when(size > 0, _numbers(raw, here, size, n)).otherwise(F.array().cast("array<int>"))
        out = out.withColumns({f"__{k}": each, f"__at{at + 1}": (here + n * size).cast("int")})
        at += 1
    out = out.withColumn("__c", (F.ceil(c(f"__at{at}") / 8) * 8).cast("int")).withColumn("__size", take(c("__c"), 8).cast("int"))
    err = F.when(F.length(raw) < 5, "short").when(F.hex(F.substring(raw, 1, 4)) != b"ADIF".hex(), "mark")
    err = err.when(take(c("__a") + 26, 4) > 0, "programs").when(take(c("__p") + 6, 4).isin(13, 14), "rate").when(c("__size").isNull() | (8 * F.length(raw) < c("__c") + 8 + 8 * c("__size")), "short")
    twos = lambda k: F.aggregate(c(f"__{k}"), F.lit(0), lambda a, e: a + 1 + F.shiftright(e, 4))
    out = out.withColumn("err", err)
    some = lambda v: F.when(c("err").isNull(), v)
    flat = lambda k: some(F.array_join(F.transform(c(f"__{k}"), lambda v: v.cast("string")), ",")).alias(k)
    return out.select(
        *[c(x) for x in df.columns], "err", some(take(c("__a"), 1) == 1).alias("original"), some(take(c("__a") + 1, 1) == 1).alias("home"), some(take(c("__a") + 2, 1) == 1).alias("varies"),
        some(take(c("__a") + 3, 23).cast("int")).alias("bitrate"), some(c("__mono")).alias("mono"), some(c("__stereo")).alias("stereo"), some(c("__matrix")).alias("matrix"),
        *[flat(k) for k in sizes], some(twos("front") + twos("side") + twos("back") + c("__n_low")).alias("channels"), some(F.expr("(__c + 8) div 8").cast("int") + c("__size")).alias("stop"),
    )
