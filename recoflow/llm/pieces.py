"""Splitting text into the pieces that a tokenizer treats independently.

A byte-pair tokenizer first cuts a text with a pattern and then merges inside
each piece, so a piece gives the same ids wherever it stands.  The functions
here cut a whole block of documents at once with numpy, find its distinct pieces
(hashed, then compared code point by code point), and spread the ids of distinct
pieces back over all occurrences.  Only distinct pieces meet the slow encoder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

#: Code points that one block of documents holds before it is worked on; a longer
#: document forms a block of its own.
BLOCK_CHARS = 1_500_000


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for m in regex.finditer(pattern, every):
            first, last = ord(every[m.start()]), ord(every[m.end() - 1])
            table[first : last + 1] = kind
    table[0xD800:0xE000] = OTHER
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _contractions(cps: np.ndarray, kinds: np.ndarray, starts: np.ndarray, runs: np.ndarray, docs: np.ndarray, fold: bool) -> None:
    """Mark 's 't 'm 'd 're 've 'll as pieces where an apostrophe begins a piece."""
    n = len(cps)
    at = np.flatnonzero(cps[:-1] == 0x27)
    at = at[starts[at] & runs[at + 1] & ~docs[at + 1] & (kinds[at + 1] == LETTER)]
    if not len(at):
        return
    lower = (lambda c: np.where((c >= 65) & (c <= 90), c + 32, c)) if fold else (lambda c: c)
    one = lower(cps[at + 1])
    inside = at + 2 < n
    second = np.minimum(at + 2, n - 1)
    inside &= ~runs[second]
    two = np.where(inside, lower(cps[second]), 0)
    r, v, e, ell = map(ord, "rvel")
    long = ((one == r) & (two == e)) | ((one == v) & (two == e)) | ((one == ell) & (two == ell))
    short = np.isin(one, [ord(c) for c in "stmd"])
    for found, length in ((at[short], 1), (at[long], 2)):
        starts[found + 1] = False
        after = found + 1 + length
        starts[after[after < n]] = True


def byte_level_starts(cps: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece starts and ends under the byte-level pattern (a run of letters, numbers
    or other signs takes one blank before it; white space keeps its last character
    for what follows)."""
    n = len(cps)
    kinds = class_table()[cps]
    runs = np.ones(n, bool)
    runs[1:] = kinds[1:] != kinds[:-1]
    docs = np.zeros(n, bool)
    docs[doc_starts[doc_starts < n]] = True
    runs |= docs
    starts = runs.copy()
    after_space = np.flatnonzero(runs[1:] & ~docs[1:] & (kinds[:-1] == SPACE)) + 1
    starts[after_space - 1] = True
    starts[after_space[cps[after_space - 1] == 0x20]] = False
    _contractions(cps, kinds, starts, runs, docs, fold=False)
    begin = np.flatnonzero(starts)
    return begin, np.append(begin[1:], n)


def word_starts(cps: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece starts and ends under the word pattern: runs of letters, single numbers,
    runs of other signs; white space belongs to no piece."""
    n = len(cps)
    kinds = class_table()[cps]
    runs = np.ones(n, bool)
    runs[1:] = kinds[1:] != kinds[:-1]
    docs = np.zeros(n, bool)
    docs[doc_starts[doc_starts < n]] = True
    runs |= docs
    starts = runs | (kinds == NUMBER)
    _contractions(cps, kinds, starts, runs, docs, fold=True)
    begin = np.flatnonzero(starts)
    end = np.append(begin[1:], n)
    solid = kinds[begin] != SPACE
    return begin[solid], end[solid]


def distinct_pieces(cps: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each piece, index of the first piece with each code), exactly."""
    lengths = end - begin
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = int(lengths.sum())
    place = np.arange(total, dtype=np.int64) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    chars = cps if total == len(cps) else cps[np.repeat(begin, lengths) + place]
    weights = np.random.default_rng(7).integers(1, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = (chars + np.uint64(1)) * weights[place & 63]
    mixed += (place >> 6).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    hashes = np.add.reduceat(mixed, np.cumsum(lengths) - lengths)
    codes, uniques = pd.factorize(hashes)
    first = np.empty(len(uniques), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    same = np.array_equal(lengths, lengths[first][codes]) and np.array_equal(chars, cps[np.repeat(begin[first][codes], lengths) + place])
    if not same:  # two pieces share a hash: tell them apart by their characters
        keys = [cps[b:e].tobytes() for b, e in zip(begin, end, strict=True)]
        codes, uniques = pd.factorize(np.array(keys, dtype=object))
        first = np.empty(len(uniques), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, first


def spread(flat: np.ndarray, offsets: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate flat[offsets[s]:offsets[s+1]] for s in slots; also the start of each."""
    lengths = (offsets[1:] - offsets[:-1])[slots]
    ends = np.cumsum(lengths)
    begin = ends - lengths
    total = int(ends[-1]) if len(ends) else 0
    index = np.arange(total, dtype=np.int64) + np.repeat(offsets[slots] - begin, lengths)
    return flat[index], begin


def blocks(texts: list[str], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` code points."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def flatten(ids: list) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, number of ids of each entry) of a list of id sequences."""
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths


class PieceEncoder:
    """Encodes blocks of texts through an encoder of distinct pieces.

    ``encode`` maps a list of pieces to (all their ids, number of ids of each).
    ``whole`` encodes one text and serves those for which ``special`` is true (texts
    in which special strings or context-dependent characters stop pieces from being
    independent).  The ids of about ``memory`` pieces are remembered.
    """

    def __init__(self, starts: Callable, encode: Callable, whole: Callable | None = None, special: Callable[[str], bool] | None = None, prepare: Callable[[str], str] | None = None, memory: int = 400_000):
        self.starts, self.encode, self.whole, self.special, self.prepare = starts, encode, whole, special, prepare
        self.memory = memory
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.offsets = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def slots(self, pieces: list[str]) -> np.ndarray:
        """Where the ids of each of these distinct pieces stand in ``flat``."""
        known = self.known
        new = [p for p in pieces if p not in known]
        if known and len(known) + len(new) > self.memory:
            self.forget()
            known, new = self.known, pieces
        if new:
            flat, lengths = self.encode(new)
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.flat = np.concatenate([self.flat, flat])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lengths)])
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    def block(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (uint32) of each text of one block."""
        out: list[np.ndarray | None] = [None] * len(texts)
        usual = []
        for i, text in enumerate(texts):
            if self.special is not None and self.special(text):
                out[i] = np.asarray(self.whole(text), np.uint32)
            else:
                usual.append(i)
        plain = [self.prepare(texts[i]) if self.prepare else texts[i] for i in usual]
        joined = "".join(plain)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in plain], dtype=np.int64)]).astype(np.int64)
        if joined:
            cps = code_points(joined)
            begin, end = self.starts(cps, bounds[:-1])
            codes, first = distinct_pieces(cps, begin, end)
            slots = self.slots([joined[b:e] for b, e in zip(begin[first].tolist(), end[first].tolist(), strict=True)])
            tokens, token_begin = spread(self.flat, self.offsets, slots[codes])
            where = np.append(token_begin, len(tokens))[np.searchsorted(begin, bounds)]
        else:
            tokens, where = np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        for k, i in enumerate(usual):
            out[i] = tokens[where[k] : where[k + 1]]
        return out

    def texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        for a, b in blocks(texts):
            yield from self.block(texts[a:b])
