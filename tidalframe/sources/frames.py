"""Byte streams as frames: header fields and writers as column expressions, a scanner that resynchronises.

Files are read by Spark's own ``binaryFile`` source, so any store that Spark reads will do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.crc import CRC16, crcs

#: Fixed values of the framing: header bytes, longest frame, first invalid rate index.
HEADER, LONGEST, RATES = 7, 8191, 13

FRAME_FIELDS = [
    T.StructField("seq", T.LongType()),
    T.StructField("offset", T.LongType()),
    T.StructField("profile", T.IntegerType()),
    T.StructField("rate_index", T.IntegerType()),
    T.StructField("channels", T.IntegerType()),
    T.StructField("frame_length", T.IntegerType()),
    T.StructField("fullness", T.IntegerType()),
    T.StructField("payload", T.BinaryType()),
]


def _bytes_of(value: Column, n: int) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * n, "0"))


def framed(payload: Column, profile: Column, rate_index: Column, channels: Column, fullness: int = 0x7FF) -> Column:
    """``payload`` behind a seven-byte header without checksum; null if it doesn't fit 13 bits of length."""
    n = F.length(payload) + HEADER
    head = (
        F.lit(0xFFF1 << 40)
        + F.shiftleft(profile.cast("long"), 38)
        + F.shiftleft(rate_index.cast("long"), 34)
        + F.shiftleft(channels.cast("long"), 30)
        + F.shiftleft(n.cast("long"), 13)
        + F.lit(fullness << 2)
    )
    return F.when(n <= LONGEST, F.concat(_bytes_of(head, HEADER), payload))


def header(data: Column) -> Column:
    """The fields of a header at the start of ``data``, and err: null, ``short``, ``sync``, ``layer``, ``rate`` or ``length``."""
    byte = lambda i: F.conv(F.hex(F.substring(data, i + 1, 1)), 16, 10).cast("int")
    bits = lambda x, right, mask: F.shiftright(x, right).bitwiseAND(F.lit(mask))
    absent = bits(byte(1), 0, 1)
    size = F.when(absent == 1, HEADER).otherwise(HEADER + 2)
    length = F.shiftleft(bits(byte(3), 0, 3), 11) + F.shiftleft(byte(4), 3) + bits(byte(5), 5, 7)
    err = (
        F.when(F.length(data) < HEADER, "short")
        .when((byte(0) != 255) | (bits(byte(1), 4, 15) != 15), "sync")
        .when(bits(byte(1), 1, 3) != 0, "layer")
        .when(F.length(data) < size, "short")
        .when(bits(byte(2), 2, 15) >= RATES, "rate")
        .when(length < size, "length")
    )
    return F.struct(
        err.alias("err"),
        bits(byte(1), 3, 1).alias("version"),
        (absent == 0).alias("checked"),
        bits(byte(2), 6, 3).alias("profile"),
        bits(byte(2), 2, 15).alias("rate_index"),
        (F.shiftleft(bits(byte(2), 0, 1), 2) + bits(byte(3), 6, 3)).alias("channels"),
        length.alias("frame_length"),
        (F.shiftleft(bits(byte(5), 0, 31), 6) + bits(byte(6), 2, 63)).alias("fullness"),
        (bits(byte(6), 0, 3) + 1).alias("blocks"),
    )


def loas_framed(payload: Column) -> Column:
    """``payload`` behind an 11-bit sync word and a 13-bit length."""
    return F.when(F.length(payload) <= LONGEST, F.concat(_bytes_of(F.lit(0x2B7 << 13) + F.length(payload), 3), payload))


def loas_header(data: Column) -> Column:
    """(ok, length) of a frame that ``loas_framed`` wrote."""
    head = F.conv(F.hex(F.substring(data, 1, 3)), 16, 10).cast("long")
    length = head.bitwiseAND(F.lit(0x1FFF)).cast("int")
    return F.struct(((F.length(data) >= 3) & (F.shiftright(head, 13) == 0x2B7) & (F.length(data) >= length + 3)).alias("ok"), length.alias("length"))


def _fields(data: bytes, at: int) -> tuple | None:
    """Fields of a valid header at ``at``, its size and the frame's; None if it isn't one."""
    b = data[at : at + HEADER + 2]
    if len(b) < HEADER or b[0] != 255 or b[1] & 0xF6 != 0xF0:
        return None
    size = HEADER if b[1] & 1 else HEADER + 2
    rate, length = b[2] >> 2 & 15, (b[3] & 3) << 11 | b[4] << 3 | b[5] >> 5
    if len(b) < size or rate >= RATES or length < size:
        return None
    return b[2] >> 6, rate, (b[2] & 1) << 2 | b[3] >> 6, length, (b[5] & 31) << 6 | b[6] >> 2, size, length


class Scanner:
    """Frames of a stream that comes in pieces of any size; bytes outside frames are counted.

    A header that promises more than has come makes the scanner wait, unless a complete frame starts
    later in what it holds: then the header was a false one.
    """

    #: Bytes that decide whether a header is one, at least and at most.
    shortest, longest = HEADER, HEADER + 2

    def __init__(self, held: bytes = b"", offset: int = 0, seq: int = 0, discarded: int = 0):
        self.held, self.offset, self.seq, self.discarded = held, offset, seq, discarded

    def state(self) -> tuple[bytes, int, int, int]:
        return self.held, self.offset, self.seq, self.discarded

    def push(self, piece: bytes) -> list[tuple]:
        data, at, out = self.held + piece, 0, []
        while True:
            start = self._sync(data, at)
            self.discarded += start - at
            at = start
            if len(data) - at < self.shortest:
                break
            fields = self.fields(data, at)
            if fields is None:
                if len(data) - at < self.longest and data[at + 1] & 0xF7 == 0xF0:
                    break  # a checked header may still be coming
                self.discarded += 1
                at += 1
                continue
            *own, size, length = fields
            if len(data) - at < length:
                later = self._complete(data, at + 1)
                if later is None:
                    break
                self.discarded += later - at
                at = later
                continue
            out.append((self.seq, self.offset + at, *own, data[at + size : at + length]))
            self.seq += 1
            at += length
        self.held, self.offset = data[at:], self.offset + at
        return out

    @staticmethod
    def fields(data: bytes, at: int) -> tuple | None:
        return _fields(data, at)

    @staticmethod
    def _sync(data: bytes, at: int) -> int:
        """Where the next sync word starts, or the end; a last byte that may start one stays."""
        while True:
            at = data.find(b"\xff", at)
            if at < 0:
                return len(data)
            if at + 1 == len(data) or data[at + 1] >> 4 == 15:
                return at
            at += 1

    def _complete(self, data: bytes, at: int) -> int | None:
        while True:
            at = self._sync(data, at)
            if at >= len(data):
                return None
            fields = self.fields(data, at)
            if fields and len(data) - at >= fields[-1]:
                return at
            at += 1


class LoasScanner(Scanner):
    """The same for frames behind an 11-bit sync word and a 13-bit length; rows are (seq, offset, length, payload)."""

    shortest = longest = 3

    @staticmethod
    def fields(data: bytes, at: int) -> tuple | None:
        if len(data) - at < 3 or data[at] != 0x56 or data[at + 1] >> 5 != 7:
            return None
        length = (data[at + 1] & 31) << 8 | data[at + 2]
        return length, 3, length + 3

    @staticmethod
    def _sync(data: bytes, at: int) -> int:
        while True:
            at = data.find(b"\x56", at)
            if at < 0:
                return len(data)
            if at + 1 == len(data) or data[at + 1] >> 5 == 7:
                return at
            at += 1


LOAS_FIELDS = [T.StructField("seq", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("length", T.IntegerType()), T.StructField("payload", T.BinaryType())]
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def scan_pieces(pieces: DataFrame, key: str, order: str, data: str, loas: bool = False) -> DataFrame:
    """One row for each complete frame of each stream, whose ``pieces`` of any size come in ``order``.

    Spark deals streams out by key and sorts, with spilling; a task holds one scanner with an unfinished frame.
    """
    fields = LOAS_FIELDS if loas else FRAME_FIELDS
    schema = T.StructType([pieces.schema[key], *fields])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, last = None, object()
        for batch in batches:
            keys, found = [], []
            for k, piece in zip(batch.column(key).to_pylist(), batch.column(data), strict=True):
                if k != last:
                    scanner, last = (LoasScanner if loas else Scanner)(), k
                rows = scanner.push(piece.as_py() or b"")
                keys += [k] * len(rows)
                found += rows
            if found:
                arrays = [pa.array(c, _ARROW[f.dataType.simpleString()]) for c, f in zip(zip(*found, strict=True), fields, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(key).type), *arrays], names=[key, *[f.name for f in fields]])

    return pieces.select(key, order, data).repartition(F.col(key)).sortWithinPartitions(key, order).mapInArrow(scan, schema)


def bit_field(data: Column, first: int, n: int) -> Column:
    """``n`` bits, up to 48, from bit ``first`` on, most significant first; null beyond the end."""
    start, stop = first // 8, -(-(first + n) // 8)
    raw = F.conv(F.hex(F.substring(data, start + 1, stop - start)), 16, 10).cast("long")
    return F.when(F.length(data) >= stop, F.shiftright(raw, 8 * stop - first - n).bitwiseAND(F.lit((1 << n) - 1)))


def zero_from(data: Column, first: int) -> Column:
    """Whether all bits from bit ``first`` on are zero; true where there are none."""
    start, head = -(-first // 8), first % 8
    rest = F.hex(F.substring(data, start + 1, 1 << 30)).rlike("^0*$")
    if not head:
        return rest
    return rest & F.coalesce(F.conv(F.hex(F.substring(data, start, 1)), 16, 10).cast("int").bitwiseAND(F.lit((1 << 8 - head) - 1)) == 0, F.lit(True))


#: Rows that become Python values at once: a batch of 10,000 frames of 8 KB would lie there several times over.
RUN = 1024


def _runs(body: Callable[..., list], kind: pa.DataType, batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """``body``, lists to a list, of the batches' columns. These stay in Arrow's memory; RUN rows at a time are Python values, and go back before the next ones."""
    for columns in batches:
        for at in range(0, len(columns[0]), RUN):
            yield pa.array(body(*[c.slice(at, RUN).to_pylist() for c in columns]), kind)


def _positions(sizes: list[int]) -> bytes:
    at, out = 0, b""
    for n in sizes[:-1]:
        at += n + 2
        out += at.to_bytes(2, "big")
    return out


def block_frames(payloads: Column, profile: int, rate_index: Column, channels: Column) -> Column:
    """One checked frame of one to four payloads, each followed by its checksum and found by a table of 16-bit ends.

    A single payload follows the header's checksum as it is. Null if the frame doesn't fit its length field.
    """

    def packed(rows: list, rates: list, layouts: list) -> list:
        out, heads = [], []
        for blocks, rate, layout in zip(rows, rates, layouts, strict=True):
            sizes = [len(b) for b in blocks]
            table = _positions(sizes)
            size = HEADER + len(table) + 2 + sum(sizes) + (2 * len(sizes) if len(sizes) > 1 else 0)
            head = (0xFFF0 << 40) + (profile << 38) + (int(rate) << 34) + (int(layout) << 30) + (size << 13) + (0x7FF << 2) + len(sizes) - 1
            heads.append(head.to_bytes(HEADER, "big") + table if size <= LONGEST else None)
        checks = crcs([h or b"" for h in heads], *CRC16)
        ends = iter(crcs([b for blocks in rows for b in blocks], *CRC16).tolist())
        for blocks, head, check in zip(rows, heads, checks.tolist(), strict=True):
            own = [(b, next(ends).to_bytes(2, "big")) for b in blocks]
            body = own[0][0] if len(own) == 1 else b"".join(b + c for b, c in own)
            out.append(None if head is None else head + check.to_bytes(2, "big") + body)
        return out

    @F.arrow_udf("binary")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from _runs(packed, pa.binary(), batches)

    return run(payloads, rate_index, channels)


def raw_blocks(frames: Column) -> Column:
    """(block, payload, crc_ok) of each block of checked frames, or one row with ``err``: ``unprotected``, ``short`` or ``position``.

    A frame of one block passes as it is, its crc_ok is null; several blocks can be told apart only in a checked frame.
    """

    def split(rows: list) -> list:
        out, checks = [], []
        for frame in rows:
            count, checked = (frame[6] & 3) + 1, not frame[1] & 1
            bad = lambda err: [{"block": None, "payload": None, "crc_ok": None, "err": err}]
            start = HEADER + 2 * (count - 1) + 2
            if count == 1:
                out.append([{"block": 0, "payload": frame[HEADER + 2 * checked :], "crc_ok": None, "err": None}])
            elif not checked:
                out.append(bad("unprotected"))
            elif len(frame) < start:
                out.append(bad("short"))
            else:
                ends = [int.from_bytes(frame[HEADER + 2 * k : HEADER + 2 * k + 2], "big") for k in range(count - 1)] + [len(frame) - start]
                borders = list(zip([0, *ends], ends))
                if any(b < a + 2 or b > len(frame) - start for a, b in borders):
                    out.append(bad("position"))
                    continue
                made = [{"block": k, "payload": frame[start + a : start + b - 2], "crc_ok": None, "err": None} for k, (a, b) in enumerate(borders)]
                checks += [(m, int.from_bytes(frame[start + b - 2 : start + b], "big")) for m, (_, b) in zip(made, borders, strict=True)]
                out.append(made)
        for (made, want), got in zip(checks, crcs([m["payload"] for m, _ in checks], *CRC16).tolist(), strict=True):
            made["crc_ok"] = got == want
        return out

    kind = pa.list_(pa.struct([("block", pa.int32()), ("payload", pa.binary()), ("crc_ok", pa.bool_()), ("err", pa.string())]))

    @F.arrow_udf("array<struct<block: int, payload: binary, crc_ok: boolean, err: string>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _runs(split, kind, ((column,) for column in batches))

    return run(frames)


def _scanned(batches: Iterator[pa.RecordBatch], key: str, data: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, blob in zip(batch.column(key), batch.column(data), strict=True):
            found = Scanner().push(blob.as_py() or b"")
            if found:
                columns = list(zip(*found, strict=True))
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(found), batch.schema.field(key).type), *arrays], names=[key, *[f.name for f in FRAME_FIELDS]])


def scan_frames(blobs: DataFrame, key: str, data: str) -> DataFrame:
    """One row for each complete frame of each blob, in order, garbage skipped. Null and empty blobs have none."""
    schema = T.StructType([blobs.schema[key], *FRAME_FIELDS])
    return blobs.select(key, data).mapInArrow(lambda batches: _scanned(batches, key, data), schema)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames of all files under ``path``, by path."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return scan_frames(files, "path", "content")
