"""Arrow string columns as byte arrays: pieces of bounded size, word spans and hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
_BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_U64 = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# words of letters, digits and all bytes above 0x7F (of lower-cased text)
WORD = np.zeros(256, dtype=bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True
# words between blanks: everything but space and \t \n \v \f \r
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[0x20, 9, 10, 11, 12, 13]] = False


def pieces(batches: Iterator[pa.RecordBatch], column: str,
           limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut by rows so that a piece holds about ``limit`` bytes of the column.

    A single longer text is a piece of its own; texts are never cut. After the last piece
    the worker's freed memory goes back to the system, as workers wait for further tasks.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = column_bytes(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop
    batch = None
    give_back()


def give_back() -> None:
    """Return freed memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc
        trim(0)


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until the column holds about ``limit`` bytes, then cut as ``pieces``."""
    def joined():
        held, size = [], 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            size += int(column_bytes(batch.column(batch.schema.get_field_index(column)))[1][-1])
            if size >= limit:
                yield pa.concat_batches(held)
                held, size = [], 0
        if held:
            yield pa.concat_batches(held)
    return pieces(joined(), column, limit)


def batched(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold at least ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other, and the n + 1 offsets; null is empty."""
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offs, dtype=kind, count=len(col) + col.offset + 1)[col.offset:].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]]
    return raw, offsets - offsets[0]


def spans(raw: np.ndarray, offsets: np.ndarray, member: np.ndarray):
    """Starts, ends and text numbers of the maximal runs of ``member`` bytes inside each text."""
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = member[raw]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    held = offsets[1:] > offsets[:-1]
    at = offsets[:-1][held]
    first[at] = inside[1:-1][at]
    at = offsets[1:][held] - 1
    last[at] = inside[1:-1][at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_forward = _powers(_BASE, 0)
_backward = _powers(1, 0)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, equal for equal bytes wherever they stand.

    The span's polynomial is a difference of prefix sums times the inverse power of
    its start; work runs in blocks so that the scratch arrays stay small.
    """
    global _forward, _backward
    out = np.zeros(len(starts), dtype=_U64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + _BLOCK)))
        origin, reach = int(starts[lo]), int(ends[lo:hi].max())
        n = reach - origin
        if len(_forward) < n + 1:
            _forward = _powers(_BASE, n + 1)
            _backward = _powers(pow(_BASE, -1, 1 << 64), n + 1)
        sums = np.zeros(n + 1, dtype=_U64)
        np.cumsum((raw[origin:reach].astype(_U64) + _U64(1)) * _forward[:n], out=sums[1:])
        a, b = starts[lo:hi] - origin, ends[lo:hi] - origin
        out[lo:hi] = (sums[b] - sums[a]) * _backward[a]
        lo = hi
    return mixed(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all bits (one to one)."""
    h = h ^ (h >> _U64(32))
    h = h * _U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U64(32))
    h = h * _U64(0xD6E8FEB86659FD93)
    return h ^ (h >> _U64(32))


def combined(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """A hash of an ordered pair of hashes."""
    return mixed(a * _U64(0xA24BAED4963EE407) + b * _U64(0x9FB21C651E98DF25) + _U64(salt))
