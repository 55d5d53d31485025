"""Words of a batch of texts as NumPy arrays: where each word lies in the bytes, its document and a 64-bit hash."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

_U = np.uint64
_SEED = np.random.default_rng(20240229)
_LETTER = _SEED.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_STEP = _U(0x9E3779B97F4A7C15)
_STEP_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse; kept, since every batch needs the same ones."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, step in enumerate((_STEP, _STEP_INVERSE)):
            table = np.full(size, step, _U)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes: a polynomial over random letter values, from one running sum."""
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_LETTER[data] * power[:-1], out=total[1:])
    return mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(_U) * _U(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """Words of some documents, in order. ``first[d]:first[d + 1]`` are those of document ``d``."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def text(self, k: int) -> bytes:
        return self.data[self.begin[k] : self.end[k]].tobytes()


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets of each; null is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def give_back() -> None:
    """Return freed memory to the system: a reused Python worker would keep that of its largest task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def done(run: Callable, *args):
    """The result of a call, whose working memory is given back."""
    try:
        return run(*args)
    finally:
        give_back()


def released(run: Callable) -> Callable:
    """A function over batches that gives its working memory back when it ends."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each, so that working arrays stay small; a longer text stands alone."""
    offsets = raw(texts)[1]
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, stop
        start = stop


def words(texts: pa.Array, letters: np.ndarray = LOWER) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a null or empty text has none.

    Another table of ``letters`` may map other bytes, for example punctuation to spaces.
    """
    data, offsets = raw(texts)
    data = letters[data]
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(texts) + 1, np.int64), np.zeros(0, _U))
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = inside & edge[:-1]
    starts[1:] |= inside[1:] & ~inside[:-1]
    stops = inside & edge[1:]
    stops[:-1] |= inside[:-1] & ~inside[1:]
    begin, end = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    return Words(data, begin, end, np.searchsorted(begin, offsets), span_hashes(data, begin, end))


def gram_hashes(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of words, and where those of each document begin.

    A document with fewer words, but some, has one: of its whole sequence.
    """
    count = np.diff(w.first)
    size = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(size)])
    base = w.first[:-1].repeat(size) + np.arange(first[-1]) - first[:-1].repeat(size)
    length = np.minimum(count, n).repeat(size)
    total = length.astype(_U) * _U(0xA24BAED4963EE407)
    odd = np.random.default_rng(n).integers(1, 2**63, n, dtype=np.uint64) | _U(1)
    for k in range(n):
        at = base + k
        if len(w.hash):
            total += np.where(k < length, w.hash[np.minimum(at, len(w.hash) - 1)] * odd[k], _U(0))
    return mix(total), first
