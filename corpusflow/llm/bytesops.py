"""Vectorised passes over UTF-8 text as Arrow holds it: words, their 64-bit names, windows of words.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, so words never cross texts.
Names are 64-bit hashes; they are the same in every process.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Text handled at a time; the temporaries of a pass are about 40 bytes for each byte of it.
CHUNK = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (in place where possible)."""
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


BYTE_NAME = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = U64(0xD1342543DE82EF95)


@lru_cache(maxsize=4)
def _byte_names(lower: bool) -> np.ndarray:
    table = BYTE_NAME[LOWER] if lower else BYTE_NAME.copy()
    table[SPACE] = 0
    return table


_POWERS = np.ones(1, U64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base, modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        size = 1 << max(12, (n - 1).bit_length())
        full = np.full(size, _BASE, U64)
        full[0] = 1
        _POWERS = np.cumprod(full, dtype=U64)
    return _POWERS


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array without copying the text; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def count_bytes(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> np.ndarray:
    """For each text, how many of its bytes are marked in the 256-entry table ``member``."""
    out = np.zeros(len(offsets) - 1, np.int64)
    lo = 0
    while lo < len(out):
        hi = min(len(out), max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK))))
        sums = np.concatenate(([0], np.cumsum(member[data[offsets[lo] : offsets[hi]]], dtype=np.int64)))
        at = offsets[lo : hi + 1] - offsets[lo]
        out[lo:hi] = sums[at[1:]] - sums[at[:-1]]
        lo = hi
    return out


def _cuts(data: np.ndarray, offsets: np.ndarray, chunk: int):
    """Spans of about ``chunk`` bytes that end between words or texts."""
    lo, end = 0, len(data)
    while lo < end:
        hi = min(end, lo + chunk)
        while hi < end and not SPACE[data[hi]]:
            edge = int(offsets[np.searchsorted(offsets, hi)])
            ahead = np.flatnonzero(SPACE[data[hi : min(edge, hi + chunk)]])
            if len(ahead):
                hi += int(ahead[0])
            elif edge <= hi + chunk:
                hi = edge
                break
            else:
                hi += chunk
        yield lo, hi
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray, lower: bool = True):
    """(names, starts, pointers): each word's name and first byte, and each text's range of words."""
    names, places = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    table = _byte_names(lower)
    for lo, hi in _cuts(data, offsets, CHUNK):
        part = data[lo:hi]
        solid = ~SPACE[part]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        edges = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo
        first[edges] = solid[edges]
        starts = np.flatnonzero(first)
        if not len(starts):
            continue
        lengths = np.diff(np.append(starts, len(part)))
        inside = np.arange(starts[0], len(part)) - np.repeat(starts, lengths)
        values = table[part[starts[0] :]]
        values *= powers(int(lengths.max()))[inside]
        names.append(mix(np.add.reduceat(values, starts - starts[0])))
        places.append(starts + lo)
    starts = np.concatenate(places)
    return np.concatenate(names), starts, np.searchsorted(starts, offsets)


def windows(names: np.ndarray, pointers: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(names, pointers) of all n-word windows inside each text."""
    total = len(names)
    if total < n:
        return np.zeros(0, U64), np.zeros(len(pointers), np.int64)
    size = total - n + 1
    h = np.zeros(size, U64)
    for i in range(n):
        h *= U64(0x9FB21C651E98DF25)
        h += names[i : i + size]
    mix(h)
    counts = np.maximum(np.diff(pointers) - (n - 1), 0)
    out = np.concatenate(([0], np.cumsum(counts)))
    place = np.arange(out[-1]) + np.repeat(pointers[:-1] - out[:-1], counts)
    return h[place], out
