"""Encoders over public tokenizer files, one per Python worker."""

from __future__ import annotations

import base64
import unicodedata
from functools import lru_cache

import numpy as np

from recoflow.llm.pieces import PieceEncoder, byte_level_starts, flatten, spread, word_starts


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(4)
def library(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _encode(tokenizer, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _joined(tokenizer, pieces: list[str], between: str, cut) -> tuple[np.ndarray, np.ndarray]:
    """Encode pieces a few thousand at a time as one text; ``cut`` tells them apart
    (if signs of an unknown script make it find others, they go piece by piece)."""
    flat, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for i in range(0, len(pieces), 5000):
        some = pieces[i : i + 5000]
        ids, sizes = cut(np.array(_encode(tokenizer, [between.join(some)])[0], np.uint32))
        if len(sizes) != len(some):
            ids, sizes = flatten(_encode(tokenizer, some))
        flat.append(ids)
        lengths.append(sizes)
    return np.concatenate(flat), np.concatenate(lengths)


def _apart(tokenizer, pieces: list[str], odd, between: str, cut) -> tuple[np.ndarray, np.ndarray]:
    """Encode the odd pieces one by one and the others joined, in the given order."""
    alone = np.fromiter(map(odd, pieces), bool, len(pieces))
    if not alone.any():
        return _joined(tokenizer, pieces, between, cut)
    usual, usual_sizes = _joined(tokenizer, [p for p, a in zip(pieces, alone, strict=True) if not a], between, cut)
    rest, rest_sizes = flatten(_encode(tokenizer, [p for p, a in zip(pieces, alone, strict=True) if a]))
    slots = np.empty(len(pieces), np.int64)
    slots[~alone] = np.arange(len(usual_sizes))
    slots[alone] = len(usual_sizes) + np.arange(len(rest_sizes))
    offsets = np.concatenate([[0], np.cumsum(np.concatenate([usual_sizes, rest_sizes]))])
    return spread(np.concatenate([usual, rest]), offsets, slots)[0], (offsets[1:] - offsets[:-1])[slots]


@lru_cache(2)
def byte_level_encoder(path: str) -> PieceEncoder:
    """Ids of a byte-level tokenizers file; texts with its special strings go whole."""
    tokenizer = library(path)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    line_end = tokenizer.token_to_id("\u010a")

    def cut(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.append(np.flatnonzero(ids == line_end), len(ids))
        return ids[ids != line_end], np.diff(at, prepend=-1) - 1

    return PieceEncoder(
        byte_level_starts,
        lambda pieces: _apart(tokenizer, pieces, lambda p: not p.strip() or "\n" in p, "\n", cut),
        whole=lambda text: _encode(tokenizer, [text])[0],
        special=lambda text: any(a in text for a in added),
    )


@lru_cache(2)
def word_encoder(path: str) -> PieceEncoder:
    """Ids of the lower-casing word tokenizer.  Texts are brought to NFC first, since
    that may join characters; the dotted capital I lower-cases to a letter and a mark
    and so goes through the library whole."""
    tokenizer = library(path)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    ends_word = np.zeros(tokenizer.get_vocab_size(), bool)
    ends_word[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    def cut(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ids, np.diff(np.flatnonzero(ends_word[ids]), prepend=-1)

    return PieceEncoder(
        word_starts,
        lambda pieces: _apart(tokenizer, pieces, lambda p: not p.isascii() and len(p.lower()) != len(p), " ", cut),
        whole=lambda text: _encode(tokenizer, [text])[0],
        special=lambda text: "\u0130" in text or any(a in text for a in added),
        prepare=lambda text: unicodedata.normalize("NFC", text),
    )


@lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    """Rank of every token of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
