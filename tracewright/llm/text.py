"""Vectorised views of a batch of texts: words, their 64-bit hashes, and slices of bounded size.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]`` after lower-casing A-Z only.  All of
it works on UTF-8 bytes, where neither the six blanks nor A-Z can be part of a longer character.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step takes; a single longer document is a step of its own.
STEP_BYTES = 1 << 19

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C13  # = 3 mod 8, so that 1 - base has one factor 2 only
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_powers[0]):
        size = max(n, 2 * STEP_BYTES)
        tables = []
        for base in (_BASE, _INVERSE):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            tables.append(np.cumprod(table))
        if size > 4 * STEP_BYTES:  # for one very long document: not kept
            return tables[0][:n], tables[1][:n]
        _powers[:] = tables
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection) over an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts: ``data`` (lower-cased bytes, texts joined by blanks), ``start``, ``end``
    (byte offsets), ``doc`` (row of each word) and ``first`` (index of each row's first word, one more
    entry than rows)."""

    def __init__(self, texts: list[bytes], blanks: np.ndarray = _BLANK):
        self.data = np.frombuffer(b" ".join([*texts, b""]).lower() if texts else b" ", np.uint8)
        blank = blanks[self.data]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if not blank[0]:
            edge = np.concatenate(([0], edge))
        if len(edge) % 2:
            edge = np.append(edge, len(self.data))
        self.start, self.end = edge[::2], edge[1::2]
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.start, offsets)
        self.first[-1] = len(self.start)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the bytes from each start to each end; equal bytes, equal hash; never 0."""
        if not hasattr(self, "_sums"):
            power, self._inverse = _power_tables(len(self.data) + 1)
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=self._sums[1:])
        h = (self._sums[end] - self._sums[start]) * self._inverse[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)


def slices(batches, column: str = "text", step: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each Arrow batch in slices of about ``step`` bytes of text, with that text as bytes (null: empty)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column).cast(pa.binary())
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64) + 1)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, "right")))
            yield batch.slice(at, to - at), [t or b"" for t in texts.slice(at, to - at).to_pylist()]
            at = to
    release()


def release() -> None:
    """Hand free memory back to the system: a worker lives on after its task."""
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
