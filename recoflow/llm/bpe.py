"""Operator 10: byte-level BPE encoding and decoding in padded numpy matrices.

Distinct pieces are grouped by length into matrices with one row a piece.  In each
round every row merges its leftmost pair of least rank; pairs are found in an
open-addressed hash table held in numpy arrays; rows without a further pair leave
the matrix.

Padding long pieces to one width would waste memory, and a round each for their many
merges would take the square of their length.  So pieces of more than MATRIX_BYTES are
the rows of a ragged matrix, one flat array with a gap between rows.  As long as a merge
only makes pairs of higher ranks, a row's turns with one rank follow each other; a round
does all turns of one rank in all rows, at the places where a pair has that rank.  A
token that can be in a pair of lower rank is made once a row and round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from recoflow.llm.common import small_batches, texts
from recoflow.llm.pieces import PieceEncoder, byte_level_starts, spread
from recoflow.llm.tokenizers_io import ranks as load_ranks

NO_RANK = np.int32(2**31 - 1)
#: Longest piece, in bytes, that goes into a padded matrix.
MATRIX_BYTES = 256


class PairTable:
    """Hash table from (left id, right id) to the rank of the merged token."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        keys = self._key(left, right)
        self.bits = max(8, int(4 * len(keys)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)  # 0: free, since a key holds left + 1
        self.values = np.full(1 << self.bits, NO_RANK, np.int32)
        slot, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):  # each round, one of the keys that want a free slot gets it
            free = self.keys[slot[rest]] == 0
            wanting = rest[free]
            self.keys[slot[wanting]] = keys[wanting]
            placed = self.keys[slot[rest]] == keys[rest]
            self.values[slot[rest[placed]]] = rank[rest[placed]]
            rest = rest[~placed]
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return ((left.astype(np.uint64) + np.uint64(1)) << np.uint64(32)) | right.astype(np.uint64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NO_RANK where there is none or an id is negative."""
        keys = self._key(left, right)
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NO_RANK)
        rest = np.flatnonzero((found != keys) & (found != 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.values[slot[rest[hit]]]
            rest = rest[~hit & (found != 0)]
        out[(left < 0) | (right < 0)] = NO_RANK
        return out


def last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[int, int] | None:
    """Ranks of the two parts that merging the token's bytes ends with, if it does.  No
    other two parts of it ever stand side by side, in whatever text: merges inside a span
    follow the same order until one crosses its ends."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min((ranks.get(a + b, NO_RANK), i) for i, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True)))
        if best[0] == NO_RANK:
            return None
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return ranks[parts[0]], ranks[parts[1]]


class MatrixBpe:
    """Encoder and decoder for a table of token ranks, where a rank is also the id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(*last, r) for t, r in ranks.items() if len(t) > 1 and (last := last_pair(t, ranks))]
        left, right, rank = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.pairs = PairTable(left, right, rank)
        self.risky = np.zeros(int(rank.max()) + 1, bool)  # tokens with a part in a pair of lower rank
        for part in (left, right):
            self.risky[part[part > rank]] = True
        tokens = sorted((r, t) for t, r in ranks.items())
        lengths = np.zeros(tokens[-1][0] + 1, np.int64)
        lengths[[r for r, _ in tokens]] = [len(t) for _, t in tokens]
        self.token_offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.token_bytes = np.frombuffer(b"".join(t for _, t in tokens), np.uint8)

    def _matrix(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rows of ids (padded with -1); (merged rows, number of ids of each)."""
        n, length = ids.shape
        out, sizes = np.full((n, length), -1, np.int32), (ids >= 0).sum(1)
        rows = np.arange(n)
        pair_ranks = self.pairs.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, length - 1)
        columns = np.arange(length)
        while len(rows):
            best = pair_ranks.argmin(1)
            every = np.arange(len(rows))
            rank = pair_ranks[every, best]
            going = rank != NO_RANK
            if not going.all():
                done = ~going
                out[rows[done], : ids.shape[1]] = ids[done]
                rows, ids, pair_ranks, best, rank = rows[going], ids[going], pair_ranks[going], best[going], rank[going]
                every = np.arange(len(rows))
                if not len(rows):
                    break
            width = ids.shape[1]
            ids[every, best] = rank
            sizes[rows] -= 1
            # drop the column after each merge; the ranks beside it change
            keep = columns[: width - 1] + (columns[: width - 1] > best[:, None])
            ids = np.take_along_axis(ids, keep, 1)
            if width == 2:
                out[rows, :1] = ids
                break
            gone = np.minimum(columns[: width - 2] + (columns[: width - 2] >= best[:, None]), width - 2)
            pair_ranks = np.take_along_axis(pair_ranks, gone, 1)
            before = best > 0
            if before.any():
                r, c = every[before], best[before]
                pair_ranks[r, c - 1] = self.pairs.ranks(ids[r, c - 1], ids[r, c])
            after = best < width - 2
            if after.any():
                r, c = every[after], best[after]
                pair_ranks[r, c] = self.pairs.ranks(ids[r, c], ids[r, c + 1])
        return out, sizes

    def _ragged(self, ids: np.ndarray) -> np.ndarray:
        """Merge rows of ids that stand one after another, each followed by a -1."""
        n, row = len(ids), np.cumsum(ids == -1)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        pair_ranks = np.append(self.pairs.ranks(ids[:-1], ids[1:]), NO_RANK)
        places: dict[int, list[np.ndarray]] = {}
        ranks = np.zeros(len(self.token_offsets), bool)  # ranks that some pair has

        def note(at: np.ndarray) -> int:
            """Remember places by their ranks; the least of these."""
            at = at[pair_ranks[at] != NO_RANK]
            if not len(at):
                return len(ranks)
            at = at[np.argsort(pair_ranks[at], kind="stable")]
            found, first = np.unique(pair_ranks[at], return_index=True)
            ranks[found] = True
            for r, some in zip(found.tolist(), np.split(at, first[1:]), strict=True):
                places.setdefault(r, []).append(some)
            return int(found[0])

        rank = note(np.arange(n))
        while places:
            rank += int(ranks[rank:].argmax())
            ranks[rank] = False
            at = np.unique(np.concatenate(places.pop(rank)))
            at = at[pair_ranks[at] == rank]
            if self.risky[rank] and len(at):
                first = np.unique(row[at], return_index=True)[1]
                note(np.delete(at, first))
                at = at[first]
            # of pairs that overlap in a chain every other one merges, from the left
            chained = np.zeros(len(at), bool)
            chained[1:] = after[at[:-1]] == at[1:]
            first = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            gone = after[at]
            ids[at], ids[gone] = rank, -2
            pair_ranks[gone] = NO_RANK
            after[at] = after[gone]
            before[after[at]] = at  # a -1 follows each row
            pair_ranks[at] = self.pairs.ranks(ids[at], ids[after[at]])
            left = before[at][before[at] >= 0]
            pair_ranks[left] = self.pairs.ranks(ids[left], ids[after[left]])
            rank = min(rank, note(np.unique(np.concatenate([at, left]))))
        return ids[ids != -2]

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each piece)."""
        raw = [p.encode() for p in pieces]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        whole = np.fromiter((self.ranks.get(r, -1) for r in raw), np.int64, len(raw))
        sizes = np.where(whole >= 0, 1, 0)
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum(lengths)])
        limits = [*range(1, 17), 20, 24, 32, 48, 64, 96, 128, 192, MATRIX_BYTES]
        bucket = np.searchsorted(limits, lengths)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b in np.unique(bucket[whole < 0]):
            rows = np.flatnonzero((bucket == b) & (whole < 0))
            if b == len(limits):
                joined = np.concatenate([x for i in rows for x in (self.byte_ids[data[offsets[i] : offsets[i + 1]]], [-1])]).astype(np.int32)
                ids = self._ragged(joined)
                ends = np.flatnonzero(ids == -1)
                sizes[rows] = n = np.diff(ends, prepend=-1) - 1
                parts.append((np.repeat(rows, n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n), ids[ids != -1]))
                continue
            columns = np.arange(limits[b])
            inside = columns < lengths[rows, None]
            index = np.where(inside, offsets[rows, None] + columns, 0)
            ids, n = self._matrix(np.where(inside, self.byte_ids[data[index]], -1).astype(np.int32))
            sizes[rows] = n
            r, c = np.nonzero(columns < n[:, None])
            parts.append((rows[r], c, ids[r, c]))
        starts = np.cumsum(sizes) - sizes
        flat = np.zeros(int(sizes.sum()), np.uint32)
        flat[starts[whole >= 0]] = whole[whole >= 0]
        for r, c, ids in parts:
            flat[starts[r] + c] = ids
        return flat, sizes

    def decode(self, ids: np.ndarray) -> bytes:
        return spread(self.token_bytes, self.token_offsets, ids.astype(np.int64))[0].tobytes()


@lru_cache(2)
def matrix_bpe(path: str) -> tuple[MatrixBpe, PieceEncoder]:
    bpe = MatrixBpe(load_ranks(path))
    return bpe, PieceEncoder(byte_level_starts, bpe.encode)


def encode_documents(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, ids (array of int) of whole texts; null text: no ids.

    Rows map one to one, so repeated rows and null doc_ids stay as they are and an
    empty table stays empty.  Memory grows with the longest text only.
    """
    small_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encoder = matrix_bpe(ranks_path)
        for batch in batches:
            ids = list(encoder.texts(batch.column(1).to_pylist()))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "ids"])

    return texts(docs).mapInArrow(encode, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, data (binary) from doc_id, ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = matrix_bpe(ranks_path)
        for batch in batches:
            lists = batch.column(1)
            flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            data = [bpe.decode(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, data binary")


def round_trip(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256; the ids are decoded
    in the task that made them, so they never leave it.  Null text is empty (0 tokens);
    rows map one to one, so repeated rows and null doc_ids stay; further columns are
    dropped; an empty table stays empty; memory grows with the longest text only."""
    small_batches(docs.sparkSession)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encoder = matrix_bpe(ranks_path)
        for batch in batches:
            n, of_ids, of_bytes = [], [], []
            for ids in encoder.texts(batch.column(1).to_pylist()):
                n.append(len(ids))
                of_ids.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                of_bytes.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
