"""Texts of Arrow batches as byte arrays: word runs and rolling hashes without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_state

#: Bytes of text that are handled at once; a longer text is handled alone. A byte takes up to 100 bytes of numbers meanwhile.
PART_BYTES = 1_000_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Lower-cased word bytes of op10: digits, letters and all of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[ord("0") : ord("9") + 1] = ALNUM[ord("a") : ord("z") + 1] = ALNUM[128:] = True

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text starts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def parts(batch: pa.RecordBatch, text_col: str, limit: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text, a row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0)
    ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
    at = 0
    while at < len(batch):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; a run ends where a text ends."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.empty(len(inside) + 1, bool)
    edge[0], edge[-1] = True, True
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets[(offsets >= 0) & (offsets <= len(inside))]] = True
    cuts = np.flatnonzero(edge)
    kept = inside[cuts[:-1]]
    return cuts[:-1][kept], cuts[1:][kept]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    state = worker_state()
    if len(state.get("powers", ((),))[0]) >= n:
        return state["powers"]
    powers = []
    for base in (_P, _P_INVERSE):
        x = np.full(max(n, PART_BYTES + 1), base, np.uint64)
        x[0] = 1
        powers.append(np.cumprod(x, dtype=np.uint64))
    if n <= 2 * PART_BYTES:  # those of a very long text are not kept
        state["powers"] = tuple(powers)
    return tuple(powers)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes, the same wherever the run stands."""
    up, down = _power(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mixed(h)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive hashes."""
    total = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for i in range(n):
        total *= _Q
        total += hashes[i : len(hashes) - n + 1 + i]
    return mixed(total)
