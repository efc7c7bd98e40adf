"""Words of letters, as code points: maximal runs of letters, lower-cased one code point at a time."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from .bytesops import CHUNK, U64, mix, powers

_TOP = 0x110000


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(is a letter, lower case) of every code point."""
    points = [chr(i) for i in range(_TOP)]
    letter = np.fromiter((c.isalpha() for c in points), bool, _TOP)
    lower = np.arange(_TOP, dtype=np.uint32)
    for i in np.flatnonzero(letter).tolist():
        small = points[i].lower()
        if len(small) == 1:
            lower[i] = ord(small)
    return letter, lower


def point_name(points: np.ndarray) -> np.ndarray:
    return mix((points.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15))


class LetterWords:
    """Letter words of a block of texts.

    ``names`` holds each word's 64-bit name, ``text`` its row, ``start`` and ``length`` its place in
    ``points`` (lower-cased code points of the whole block).
    """

    def __init__(self, texts: list[str]) -> None:
        letter, lower = tables()
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.points = lower[raw]
        solid = letter[raw]
        edges = np.concatenate(([0], np.cumsum(lengths)))
        first = solid.copy()
        if len(solid):
            first[1:] &= ~solid[:-1]
            inner = edges[:-1][lengths > 0]
            first[inner] = solid[inner]
        self.start = np.flatnonzero(first)
        stop = solid.copy()
        if len(solid):
            stop[:-1] &= ~solid[1:]
            last = edges[1:][lengths > 0] - 1
            stop[last] = solid[last]
        self.length = np.flatnonzero(stop) - self.start + 1
        self.text = np.searchsorted(edges, self.start, side="right") - 1
        self.rows = len(texts)
        self.spread = np.where(solid, point_name(self.points), U64(0))
        self.names = self.span_names(self.start, self.length)

    def span_names(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Names of spans that lie inside words; equal letters give equal names."""
        if not len(start):
            return np.zeros(0, U64)
        total = np.cumsum(length)
        inside = np.arange(total[-1]) - np.repeat(total - length, length)
        values = self.spread[np.repeat(start, length) + inside]
        values *= powers(int(length.max()))[inside]
        return mix(np.add.reduceat(values, total - length))


def text_blocks(column: pa.Array, limit: int = CHUNK):
    """(first row, texts) in blocks of about ``limit`` characters; null reads as empty."""
    block, size, first = [], 0, 0
    for i, text in enumerate(column.to_pylist()):
        block.append(text or "")
        size += len(block[-1])
        if size >= limit:
            yield first, block
            block, size, first = [], 0, i + 1
    if block:
        yield first, block
