"""Vectorised word work on whole batches of texts, for use inside Arrow tasks.

A batch of texts is one byte buffer with document offsets. Words are `[^\\x20\\x09-\\x0D]+`; these separators are single
bytes in UTF-8, so all of this works on bytes. A word's hash is a polynomial in its bytes modulo 2**64, read off prefix
sums, then mixed; the same bytes always have the same hash, on any machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64-bit words."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        factor = _BASE if kind == "up" else _INVERSE
        steps = np.full(max(n, 1 << 16), factor, U)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind][:n]


def chunks(texts: pa.Array, most: int = 500_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with at most so many bytes, or of one longer row. Null counts as ''."""
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if n else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        end = min(end, n)
        yield at, data[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    ink = ~IS_SPACE[data]
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(ink[:-1], out=first[1:])
    first[off[:-1][off[:-1] < n]] = True
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(ink[1:], out=last[:-1])
    last[off[1:][off[1:] > 0] - 1] = True
    starts = np.flatnonzero(ink & first)
    ends = np.flatnonzero(ink & last) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTES[data] * _power("up", len(data)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power("down", len(data) + 1)[starts]
    return mix(h + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def counts_per(owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, minlength=n).astype(np.int64)


def chained(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k neighbours; len(h) - k + 1 of them."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, U)
    out = mix(h[:m] + U(k))
    for j in range(1, k):
        out = mix(out * U(3) + h[j : j + m])
    return out


def sums_per(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sum of values by sorted owner; rows of 0 where there is none."""
    out = np.zeros((n, *values.shape[1:]), values.dtype)
    if len(values):
        heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        out[owner[heads]] = np.add.reduceat(values, heads, axis=0)
    return out


def code_points(data: np.ndarray) -> np.ndarray:
    """True at the first byte of each code point."""
    return (data & 0xC0) != 0x80
