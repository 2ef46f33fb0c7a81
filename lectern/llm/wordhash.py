"""Vectorised tokenising and hashing of UTF-8 text in numpy.

Texts of an Arrow batch are read as one byte buffer. Words are the maximal runs of bytes outside
``\\x20`` and ``\\x09-\\x0D``; A-Z is folded to lower case. The 64-bit hash of every word comes from one
prefix sum of ``byte * P**position`` (mod 2**64), so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

P = np.uint64(0x9E3779B97F4A7C15 | 1)
P_INVERSE = np.uint64(pow(int(P), -1, 2**64))
#: Bytes of text per block; longer single texts get a block of their own.
BLOCK = 2 << 20
#: Texts per block.
TEXTS = 512

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Breaks of plain words: white space and ASCII punctuation.
BREAKS = SPACE.copy()
BREAKS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, BLOCK + 1)
        for key, base in (("up", P), ("down", P_INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[key] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 (in place on a fresh array)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def hash_words(words: list[str]) -> np.ndarray:
    """Hashes of single words, equal to those found inside texts."""
    return Words.of(words).hash


class Words:
    """Word hashes of a block of texts. Text ``d`` has ``hash[ptr[d]:ptr[d + 1]]``."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE):
        n = len(raw)
        self.raw, self.offsets = raw, offsets
        space = breaks[raw]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        before = np.ones(n, bool)
        before[1:] = space[:-1]
        before |= first[:n]
        after = np.ones(n, bool)
        after[:-1] = space[1:]
        after |= first[1:]
        self.starts = np.flatnonzero(before & ~space)
        self.ends = np.flatnonzero(after & ~space) + 1
        up, down = powers(n + 1)
        self.total = total = np.zeros(n + 1, np.uint64)
        np.cumsum((LOWER[raw].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        self.hash = mix((total[self.ends] - total[self.starts]) * down[self.starts])
        self.ptr = np.searchsorted(self.starts, offsets)

    @classmethod
    def of(cls, texts: list[str | None]) -> Words:
        data = [(t or "").encode() for t in texts]
        return cls(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``size`` bytes inside a word, and the text each is from."""
        lengths = self.ends - self.starts
        many = np.maximum(lengths - size + 1, 0)
        ends = np.cumsum(many)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts - (ends - many), many)
        _, down = powers(len(self.raw) + 1)
        return mix((self.total[at + size] - self.total[at]) * down[at] ^ np.uint64(0xA5A5A5A5A5A5A5A5)), np.repeat(self.text_of_word, many)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    @property
    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), self.counts)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``size`` consecutive words and their pointers; a shorter text is one shingle, an empty one none."""
        n, counts = len(self.hash), self.counts
        many = np.maximum(counts - size + 1, (counts > 0).astype(counts.dtype))
        ptr = np.concatenate([[0], np.cumsum(many)])
        # Start of each shingle: a running index inside each text.
        begin = np.arange(ptr[-1]) - np.repeat(ptr[:-1] - self.ptr[:-1], many)
        padded = np.concatenate([self.hash, np.zeros(size, np.uint64)])
        out = np.zeros(len(begin), np.uint64)
        short = np.repeat(counts, many) < size
        left = np.repeat(counts, many) if short.any() else None
        for k in range(size):
            part = padded[begin + k]
            if left is not None:
                part = np.where(left > k, part, np.uint64(0))
            out = out * np.uint64(0xD6E8FEB86659FD93) + part
        return mix(out), ptr


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and each row's offsets, without a copy; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64, len(texts) + 1, texts.offset * 8)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def blocks(texts: pa.Array, most: int = BLOCK, breaks: np.ndarray = SPACE) -> Iterator[tuple[int, int, Words]]:
    """Split a string column into blocks of at most ``TEXTS`` texts and ``most`` bytes (or one text): first row, end row, words."""
    raw, offsets = utf8(texts)
    rows = len(offsets) - 1
    at = 0
    while at < rows:
        end = max(at + 1, min(at + TEXTS, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1))
        own = offsets[at : end + 1]
        yield at, end, Words(raw[own[0] : own[-1]], own - own[0], breaks)
        at = end
