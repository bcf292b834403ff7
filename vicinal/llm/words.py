"""Words of UTF-8 text as 64-bit numbers, for whole Arrow columns at once.

A word's number is a polynomial in its bytes, taken from running sums over the buffer, so no Python object is made per
word. It is a fingerprint: different words share one with a chance of about 2^-64.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK = 1 << 18
_POWERS: dict[int, np.ndarray] = {}


class Words(NamedTuple):
    numbers: np.ndarray
    """uint64 per word"""
    first: np.ndarray
    """position of each text's first word, and at the end the number of words"""


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the number, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
SMALL = np.arange(256, dtype=np.uint8)
SMALL[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.empty(n, np.uint64)
        known[0], k, factor = 1, 1, base
        while k < n:
            m = min(k, n - k)
            known[k : k + m] = known[:m] * np.uint64(factor)
            k, factor = 2 * k, factor * factor % (1 << 64)
        if n <= 2 * CHUNK:
            _POWERS[base] = known
    return known


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls."""
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) else pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def bounds(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where words begin and end. Words end at white space (space, 9 to 13) and at the end of a text."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~SPACE[raw]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    full = np.flatnonzero(np.diff(at) > 0)
    opens[at[full]] = inside[at[full]]
    closes[at[full + 1] - 1] = inside[at[full + 1] - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def words(column: pa.Array, lower: bool = False) -> Words:
    """Numbers of all words of a string column without nulls; ``lower`` maps A-Z to a-z first."""
    raw, at = buffers(column)
    if lower:
        raw = SMALL[raw]
    opens, closes = bounds(raw, at)
    numbers = np.empty(len(opens), np.uint64)
    begin = 0
    while begin < len(opens):
        low = opens[begin]
        end = max(begin + 1, int(np.searchsorted(closes, low + CHUNK, "right")))
        high = closes[end - 1]
        n = int(high - low)
        up, down = powers(BASE, n + 1), powers(INVERSE, n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[raw[low:high]] * up[:n], out=sums[1:])
        a, b = opens[begin:end] - low, closes[begin:end] - low
        numbers[begin:end] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        begin = end
    return Words(numbers, np.searchsorted(opens, at))


def windows(numbers: np.ndarray, length: int, factor: int) -> np.ndarray:
    """Number of each run of ``length`` words, by position; text bounds are the caller's business."""
    n = len(numbers) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power = np.uint64(factor | 1)
    total = np.zeros(n, np.uint64)
    for k in range(length):
        total *= power
        total += numbers[k : k + n]
    return mix(total)
