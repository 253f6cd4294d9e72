"""Vectorised UTF-8 text helpers for Arrow batches.

All functions work on the raw bytes of an Arrow string column: no Python
string is made per row or word.  Words are runs of bytes of a class; since
every byte of a non-ASCII character is >= 0x80, a byte class that holds all of
0x80-0xFF treats characters as a code point class does.

Hashes are 64-bit: a polynomial over the bytes (odd base, modulo 2**64, from
prefix sums) followed by a finaliser.  Prefix sums are taken in blocks, so the
temporary arrays stay small for texts of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 2 << 20          # texts handled together by one vectorised pass
BLOCK = 1 << 18                # bytes per block of a prefix sum
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_TABLES: dict = {}


def byte_class(members) -> np.ndarray:
    """Boolean table of 256 entries, true for the bytes in ``members``."""
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


# [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing: digits, a-z, non-ASCII
ALNUM = byte_class([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
# [^\x20\x09-\x0D]
NON_SPACE = byte_class(set(range(256)) - {0x20, *range(0x09, 0x0E)})
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser, in place on a uint64 array."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _TABLES:
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("p", _BASE), ("q", inverse)):
            steps = np.full(BLOCK, base, dtype=U64)
            steps[0] = 1
            _TABLES[name] = np.cumprod(steps, dtype=U64)
    return _TABLES["p"], _TABLES["q"]


def _power(base: int, exponents: np.ndarray) -> np.ndarray:
    """base ** (BLOCK * e) modulo 2**64 for the block numbers e."""
    low, high = (int(exponents[0]), int(exponents[-1])) if len(exponents) else (0, 0)
    step = pow(base, BLOCK, 1 << 64)
    table = np.full(high - low + 1, step, dtype=U64)
    table[0] = pow(step, low, 1 << 64)
    return np.cumprod(table, dtype=U64)[exponents - low]


def prefix_at(data: np.ndarray, positions: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Prefix sums of codes[data[i]] * base**i at ascending ``positions``."""
    power, _ = _powers()
    out = np.empty(len(positions), dtype=U64)
    carry, done = U64(0), 0
    step = pow(_BASE, BLOCK, 1 << 64)
    shift = 1
    with np.errstate(over="ignore"):
        for at in range(0, max(len(data), 1), BLOCK):
            block = data[at:at + BLOCK]
            sums = np.empty(len(block) + 1, dtype=U64)
            sums[0] = 0
            terms = codes[block]
            terms *= power[:len(block)]
            np.cumsum(terms, out=sums[1:])
            last = at + BLOCK >= len(data)
            stop = len(positions) if last else int(np.searchsorted(positions, at + BLOCK, "left"))
            out[done:stop] = sums[positions[done:stop] - at] * U64(shift) + carry
            carry = carry + sums[-1] * U64(shift)
            shift = shift * step & _MASK
            done = stop
    return out


CODES = np.arange(1, 257, dtype=U64)
CODES_LOWER = CODES[LOWER]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                lower: bool = False) -> np.ndarray:
    """Hash of data[s:e] for ascending, equally many starts and ends."""
    codes = CODES_LOWER if lower else CODES
    if not len(starts):
        return np.empty(0, dtype=U64)
    with np.errstate(over="ignore"):
        h = prefix_at(data, ends, codes) - prefix_at(data, starts, codes)
        _, inverse = _powers()
        h *= inverse[starts & (BLOCK - 1)]
        blocks = starts // BLOCK
        if blocks[-1]:
            h *= _power(pow(_BASE, -1, 1 << 64), blocks)
        h += (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)
        return mix(h)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type)
                                  or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)
    bounds = bounds[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[bounds[0]:bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, at least one row each."""
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = int(np.searchsorted(bounds, bounds[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def word_spans(data: np.ndarray, bounds: np.ndarray, members: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per-row offsets of the words; rows end words."""
    inside = members[data]
    n = len(data)
    if not n:
        return (np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(bounds), np.int64))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds, "left")


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Order-dependent hash of each ``size`` consecutive word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    out = np.zeros(n, dtype=U64)
    factor = 1
    with np.errstate(over="ignore"):
        for j in range(size):
            factor = factor * 0xC2B2AE3D27D4EB4F & _MASK
            out += words[j:j + n] * U64(factor)
    return mix(out)


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """Row number of each item of a flat array with these row offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def within_rows(offsets: np.ndarray, size: int) -> np.ndarray:
    """For each window start of the flat array: true if it stays in its row."""
    n = int(offsets[-1]) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    return np.repeat(offsets[1:], np.diff(offsets))[:n] - np.arange(n) >= size


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct values (a sort; faster than a hash table here)."""
    keys = np.sort(keys)
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True where at least one of the ranges [start, end) lies."""
    edge = np.bincount(starts, minlength=n + 1)[:n + 1] - np.bincount(ends, minlength=n + 1)[:n + 1]
    return np.cumsum(edge)[:n] > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return np.diff(total[offsets])
