"""Sets of word shingles as 64-bit hashes, for blocks of texts in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20240)
_BYTE_WEIGHTS = _RNG.integers(1, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_WORD_WEIGHTS = _RNG.integers(1, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """The words of a block of texts: maximal runs without 0x20 and 0x09 to 0x0D."""

    data: np.ndarray  #: UTF-8 of all texts, each followed by a line end
    solid: np.ndarray  #: which bytes belong to words
    begin: np.ndarray  #: where words begin among the solid bytes
    lengths: np.ndarray  #: their bytes
    hashes: np.ndarray  #: 64-bit hashes, with A-Z in lower case
    bounds: np.ndarray  #: text k has the words bounds[k] to bounds[k + 1]


def words_of(texts: list[str]) -> Words:
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    solid = ~blank
    first = solid.copy()
    first[1:] &= blank[:-1]
    bounds = np.concatenate([[0], np.searchsorted(np.flatnonzero(first), ends)])
    chars = data[solid].astype(np.uint64)
    begin = np.flatnonzero(first[solid])
    lengths = np.diff(np.append(begin, len(chars)))
    if not len(begin):
        return Words(data, solid, begin, lengths, chars, bounds)
    chars += np.uint64(32) * ((chars >= 65) & (chars <= 90)) + np.uint64(1)
    place = np.arange(len(chars), dtype=np.int64) - np.repeat(begin, lengths)
    chars *= _BYTE_WEIGHTS[place & 63]
    if int(lengths.max()) > 64:
        chars = np.where(place > 63, mix(chars + (place >> 6).astype(np.uint64)), chars)
    hashes = mix(np.add.reduceat(chars, begin) + lengths.astype(np.uint64) * GOLDEN)
    return Words(data, solid, begin, lengths, hashes, bounds)


def word_shingles(words: Words, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text.

    A text with fewer words than ``width`` has its whole sequence as its one shingle;
    without words, none.
    """
    n = len(words.hashes)
    mixed = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width if len(mixed) else 0):
        mixed += words.hashes[k : n - width + 1 + k] * _WORD_WEIGHTS[k]
    mixed = mix(mixed)
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(mixed[a : b - width + 1])
        elif b > a:
            yield mix((words.hashes[a:b] * _WORD_WEIGHTS[: b - a]).sum(keepdims=True) + np.array([b - a], np.uint64) * GOLDEN)
        else:
            yield np.zeros(0, np.uint64)


def shingle_sets(texts: list[str], width: int) -> Iterator[np.ndarray]:
    yield from word_shingles(words_of(texts), width)
