"""Vectorised helpers on Arrow string columns, shared by the corpus operators.

Texts stay UTF-8 buffers: a word is a run of bytes other than 0x20 and
0x09-0x0D, so words, their hashes and their shingles come from a few numpy
passes over each slice of a batch, never from per-row Python strings. Slices
hold about ``SLICE_BYTES`` of text (one document at least), which bounds memory
whatever the batch size.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def u64(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * u64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * u64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, n - 1).bit_length() if n < (1 << 16) else n + n // 4
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, u64(base))
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def space_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return t


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


class Slice:
    """Some whole texts: ``data`` bytes and ``offsets`` (one more than texts), from 0."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, lower: bool = True) -> Words:
        return Words(self, lower)


class Words:
    """The words of a slice: byte ``starts`` and ``ends``, ``doc`` (text index), 64-bit ``hashes``, ``counts`` per text."""

    def __init__(self, s: Slice, lower: bool):
        data, offsets = s.data, s.offsets
        data = lower_table()[data] if lower else data
        word = ~space_table()[data]
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        before[:1] = True
        before[1:] = ~word[:-1]
        self.starts = np.flatnonzero(word & (before | edge[:n]))
        after = np.empty(n, bool)
        after[-1:] = True
        after[:-1] = ~word[1:]
        self.ends = np.flatnonzero(word & (after | edge[1:])) + 1
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        self.counts = np.bincount(self.doc, minlength=len(s)).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        self.hashes = span_hashes(data, self.starts, self.ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64, out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * u64(0xD6E8FEB86659FD93))


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cuts a string column into slices of whole texts; a null text is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, n)
        yield Slice(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to


def lean(run: Callable) -> Callable:
    """run, a function from batches to batches, after which the worker gives back what it no longer uses: workers stay for later tasks, and what idle ones hold counts with their executor's memory."""

    def go(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
                trim(0)

    return go


_WINDOW = [u64(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64)) for k in range(64)]


def windows(w: Words, k: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every window of k words; ``short``: a text with 1 to k-1 words has one window, all its words."""
    n = w.counts
    per = np.maximum(n - k + 1, (n > 0) if short else 0).astype(np.int64)
    doc = np.repeat(np.arange(len(n)), per)
    first = np.concatenate(([0], np.cumsum(per)))
    pos = w.first[doc] + np.arange(len(doc)) - first[doc]
    h = np.zeros(len(doc), np.uint64)
    size = np.minimum(n, k)[doc]
    last = max(len(w.hashes) - 1, 0)
    whole = bool((n[n > 0] >= k).all())
    for i in range(k):
        term = w.hashes[pos + i if whole else np.minimum(pos + i, last)] * _WINDOW[i] if len(doc) else h
        h = h + (term if whole else np.where(i < size, term, np.uint64(0)))
    return doc, mix(h + size.astype(np.uint64))


def distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) in order of both, and how many each of the n texts has."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[new], h[new]
    return doc, h, np.bincount(doc, minlength=n).astype(np.int64)
