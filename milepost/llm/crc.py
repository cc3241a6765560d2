"""CRC-32 of runs of consecutive words joined by one space, as arrays.

The CRC register is linear over GF(2): running it over bytes B from state x gives
shift(x, len B) xor state(B from 0). So every word's own state is computed once and runs of
two or three words are put together from word states, without building their text.
"""

from __future__ import annotations

import zlib

import numpy as np

ONES = np.uint32(0xFFFFFFFF)
SHORT = 64  # longer words go through zlib and their own shift tables


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & np.uint32(1), (table >> np.uint32(1)) ^ np.uint32(0xEDB88320),
                         table >> np.uint32(1)).astype(np.uint32)
    return table


TABLE = _byte_table()


def _one(state: np.ndarray) -> np.ndarray:
    """The register after one zero byte."""
    return TABLE[state & np.uint32(255)] ^ (state >> np.uint32(8))


def _shift_tables() -> np.ndarray:
    """[length, byte of the register, its value] -> register after ``length`` zero bytes."""
    out = np.zeros((SHORT + 2, 4, 256), dtype=np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (np.uint32(8) * np.arange(4, dtype=np.uint32))[:, None]
    for i in range(1, len(out)):
        out[i] = _one(out[i - 1])
    return out


TABLES = _shift_tables()
FLAT = TABLES.reshape(-1)


def _apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    byte = np.uint32(255)
    return (table[0][x & byte] ^ table[1][(x >> np.uint32(8)) & byte]
            ^ table[2][(x >> np.uint32(16)) & byte] ^ table[3][x >> np.uint32(24)])


def _long_table(length: int) -> np.ndarray:
    """The shift table of any length, by squaring."""
    out, power = TABLES[0], TABLES[1]
    while length:
        if length & 1:
            out = _apply(power, out)
        power = _apply(power, power)
        length >>= 1
    return out


def shifted(x: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Registers ``x`` after ``length`` zero bytes each."""
    short = length < len(TABLES)
    at = np.where(short, length, 0) * 1024
    byte = np.uint32(255)
    out = (FLAT[at + (x & byte)] ^ FLAT[at + 256 + ((x >> np.uint32(8)) & byte)]
           ^ FLAT[at + 512 + ((x >> np.uint32(16)) & byte)] ^ FLAT[at + 768 + (x >> np.uint32(24))])
    if not short.all():
        for n in np.unique(length[~short]):
            these = length == n
            out[these] = _apply(_long_table(int(n)), x[these])
    return out


def word_states(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The register of each word's bytes, started at 0."""
    length = ends - starts
    order = np.argsort(-np.minimum(length, SHORT + 1), kind="stable")
    at, size = starts[order], length[order]
    state = np.zeros(len(order), dtype=np.uint32)
    first = int(np.count_nonzero(size > SHORT))  # the long ones come first
    for i in range(first):
        data = raw[at[i]:at[i] + size[i]].tobytes()
        state[i] = zlib.crc32(data, 0xFFFFFFFF) ^ 0xFFFFFFFF
    upto = len(order) - np.searchsorted(size[first:][::-1], np.arange(SHORT), side="right") \
        if len(order) > first else np.zeros(SHORT, dtype=np.int64)
    for j in range(SHORT):
        if upto[j] <= first:
            break
        part = slice(first, int(upto[j]))
        s = state[part]
        state[part] = TABLE[(s ^ raw[at[part] + j]) & np.uint32(255)] ^ (s >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = state
    return out


def run_crcs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray,
             longest: int = 3):
    """For run lengths 1 .. ``longest``: (text number, CRC-32) of every run inside a text."""
    own = word_states(raw, starts, ends)
    length = ends - starts
    # the state of a space and the word after it
    spaced = shifted(np.full(len(own), TABLE[32], dtype=np.uint32), length) ^ own
    register = shifted(np.full(len(own), ONES, dtype=np.uint32), length) ^ own
    out, inside = [(doc, register ^ ONES)], doc
    for n in range(1, longest):
        if len(doc) <= n:
            break
        register = shifted(register[:-1], length[n:] + 1) ^ spaced[n:]
        inside = doc[n:]
        same = doc[:-n] == inside
        out.append((inside[same], register[same] ^ ONES))
    return out
