"""Words of many texts as arrays: where they begin and end, and their 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.default_rng(2048).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x5851F42D4C957F2D
_steps: dict[str, np.ndarray] = {"on": np.zeros(0, np.uint64), "back": np.zeros(0, np.uint64)}


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Spans:
    """Hashes of spans of bytes: sums of random numbers for bytes by powers of a base, moved to the span's start."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        if len(_steps["on"]) < n:
            size = max(n, 1 << 20)
            _steps["on"], _steps["back"] = (np.cumprod(np.full(size, x, np.uint64)) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[raw] * _steps["on"][:n], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * _steps["back"][starts])


class Words:
    """The words of texts: ``starts`` and ``ends`` in ``raw``, ``first[i]`` to ``first[i + 1]`` those of text i, ``of`` each word's text."""

    def __init__(self, texts: list[bytes]):
        self.joined = b"\n".join(texts) + b"\n"
        self.raw = np.frombuffer(self.joined, np.uint8)
        word = ~_SPACE[self.raw]
        before = np.concatenate([[False], word[:-1]])
        self.starts, self.ends = np.flatnonzero(word & ~before), np.flatnonzero(~word & before)
        limits = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.starts, limits)
        self.counts = np.diff(self.first)
        self.of = np.repeat(np.arange(len(texts)), self.counts)
        self.spans = Spans(self.raw)

    def hashes(self) -> np.ndarray:
        return self.spans.hash(self.starts, self.ends)

    def prefixes(self, n: int) -> np.ndarray:
        """Hashes of the words' first ``n`` bytes."""
        return self.spans.hash(self.starts, np.minimum(self.ends, self.starts + n))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 21, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes in ``column`` and ``rows`` rows at most."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        group = np.maximum(np.cumsum(sizes) // most, 0) if len(sizes) else sizes
        start = 0
        while start < len(sizes):
            end = min(int(np.searchsorted(group, group[start], side="right")), start + rows)
            yield batch.slice(start, end - start)
            start = end
