"""Whole batches of texts as numpy arrays: words, their hashes, and chunks of bounded size."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once (one longer text makes a chunk of its own).
CHUNK_BYTES = 2 << 20

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

_powers: dict[str, np.ndarray] = {}


def _power(base: int, name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], dtype=np.uint64))[0])


@dataclass
class Words:
    """Words of a chunk: byte range of each in ``data``, hash of each, and ``first[d]:first[d + 1]`` for text d."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    sums: np.ndarray

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Which words are longer than ``size`` bytes, and the hash of that prefix of each (unlike that of any word)."""
        at = np.flatnonzero(self.ends - self.starts > size)
        a = self.starts[at]
        raw = (self.sums[a + size] - self.sums[a]) * _power(_INVERSE, "down", len(self.data))[a]
        return at, mix(raw + np.uint64(0xA24BAED4963EE407 * size & (2**64 - 1)))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def releasing(run: Run) -> Run:
    """``run``, which gives freed memory back to the system when it ends: workers live on for tasks of other stages."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(ctypes.util.find_library("c")), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return outer


def chunks(texts: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, offsets) of successive runs of whole texts; nulls are empty."""
    parts = texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]
    at = 0
    for part in parts:
        if part.null_count:
            part = part.fill_null("")
        if not pa.types.is_large_string(part.type):
            part = part.cast(pa.large_string())
        n = len(part)
        _, offs, data = part.buffers()
        off = np.frombuffer(offs, np.int64, n + 1, part.offset * 8) if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
            j = min(j, n)
            yield at + i, raw[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j
        at += n


def split_words(data: np.ndarray, offsets: np.ndarray, inside_word: np.ndarray = NOT_SPACE) -> Words:
    """Lower-cases A-Z and cuts at bytes that ``inside_word`` excludes (ASCII white space); the hash is of the bytes of a word and their number."""
    data = LOWER[data]
    n = len(data)
    inside = inside_word[data]
    if n == 0:
        zero = np.zeros(0, np.int64)
        return Words(data, zero, zero, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(1, np.uint64))
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, "up", n), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _power(_INVERSE, "down", n)[starts]
    hashes = mix(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return Words(data, starts, ends, hashes, np.searchsorted(starts, offsets), sums)


def hash_word(word: bytes) -> int:
    """The hash that :func:`split_words` gives this one word."""
    return int(split_words(np.frombuffer(word, np.uint8), np.array([0, len(word)])).hashes[0])
