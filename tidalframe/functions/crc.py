"""Checksums over byte and bit ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def crc_bits(data: bytes, start: int, stop: int, width: int, polynomial: int, register: int) -> int:
    """Bits ``start`` to ``stop`` of ``data``, most significant first, through a CRC register.

    Bits beyond the data count as zero.
    """
    top, mask = 1 << (width - 1), (1 << width) - 1
    for i in range(start, stop):
        bit = (data[i >> 3] >> (7 - (i & 7))) & 1 if i >> 3 < len(data) else 0
        feedback = bool(register & top) != bool(bit)
        register = (register << 1) & mask
        if feedback:
            register ^= polynomial
    return register


def byte_table(width: int, polynomial: int) -> list[int]:
    """What a byte adds to the register: 256 entries from the rule."""
    return [crc_bits(bytes([b]), 0, 8, width, polynomial, 0) for b in range(256)]


#: Values that still have bytes, from which on a step through all of them at once pays.
TOGETHER = 128


def crcs(values: list[bytes], width: int, polynomial: int, register: int) -> np.ndarray:
    """CRCs of whole values, a byte at a time through a table: of all of them at once while many have bytes left."""
    table, mask, up = np.array(byte_table(width, polynomial), np.int64), (1 << width) - 1, width - 8
    sizes = np.array([len(v) for v in values], np.int64)
    order = np.argsort(-sizes, kind="stable")
    data = np.frombuffer(b"".join(values), np.uint8)
    starts = (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    r, at = np.full(len(values), register, np.int64), 0
    while (left := int(np.searchsorted(-sizes, -at, side="left"))) >= TOGETHER:
        now = r[:left]
        r[:left] = ((now << 8) & mask) ^ table[((now >> up) ^ data[starts[:left] + at]) & 255]
        at += 1
    plain = table.tolist()
    for k in range(left):
        one = int(r[k])
        for b in data[starts[k] + at : starts[k] + sizes[k]].tobytes():
            one = ((one << 8) & mask) ^ plain[((one >> up) ^ b) & 255]
        r[k] = one
    out = np.empty(len(values), np.int64)
    out[order] = r
    return out


def crc_udf(width: int, polynomial: int, register: int):
    """A CRC over whole binary values, by Arrow batches; null of null."""

    @F.pandas_udf("int")
    def crc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = pd.Series(crcs([v or b"" for v in batch], width, polynomial, register), dtype="Int32")
            out[batch.isna().to_numpy()] = pd.NA
            yield out

    return crc


#: The checksums' widths, polynomials and initial registers.
CRC16 = (16, 0x8005, 0xFFFF)
CRC8 = (8, 0x1D, 0xFF)
