"""Operator 2: bound-certified best-fit packing of documents into sequences.

Tokenised documents (cut where they are longer than a sequence) are dealt to groups
of bounded size by a hash.  Each group packs its pieces by best-fit decreasing and
compares its number of sequences with lower bounds from dual-feasible functions.  A
group that meets its bound is certified.  Each group gives up its emptiest sequences,
the more the larger its gap; the pieces given up by all groups are dealt to fewer
groups and packed again, round after round, until one group of bounded size is left.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflow.llm.common import small_batches, texts, written
from recoflow.llm.tokenizers_io import word_encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def lower_bound(sizes: np.ndarray, capacity: int, most_k: int = 6) -> int:
    """Least number of bins that dual-feasible functions allow for ``sizes``.

    Functions: the identity; U_e (sizes above capacity - e count as a whole bin, sizes
    below e as nothing); u_k (a size counts by the multiples of capacity / (k + 1)
    that it reaches); and u_k after U_e.  Each maps sizes that fit one bin together to
    values of one bin at most, so the sum over capacity, rounded up, is a bound.
    """
    if not len(sizes):
        return 0
    s, n = np.unique(sizes.astype(np.int64), return_counts=True)
    e = np.concatenate([[0], s[s <= capacity // 2]])[:, None]
    cut = np.where(s > capacity - e, capacity, np.where(s < e, 0, s))
    best = int((-(-(cut @ n) // capacity)).max())
    for k in range(1, most_k + 1):
        reach = (k + 1) * cut
        # in units of 1 / (k * capacity): exact integers
        value = np.where(reach % capacity == 0, k * cut, reach // capacity * capacity)
        best = max(best, int((-(-(value @ n) // (k * capacity))).max()))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each size: largest first, each into the fullest bin that still takes it."""
    out = np.empty(len(sizes), np.int64)
    rooms: list[int] = []  # distinct free rooms, ascending
    bins: dict[int, list[int]] = {}  # room: bins that have it
    opened = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(rooms, size)
        if at == len(rooms):
            room, b = capacity, opened
            opened += 1
        else:
            room = rooms[at]
            b = bins[room].pop()
            if not bins[room]:
                del bins[room], rooms[at]
        out[i] = b
        left = room - size
        if left:
            if left not in bins:
                bins[left] = []
                insort(rooms, left)
            bins[left].append(b)
    return out


def pack_group(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """(bin of each size, whether its bin is given up, whether the group is certified).

    A group gives up its emptiest bins, until their free room would hold two bins, and
    two more for each bin that it has above its bound.  (A certified group also loses
    up to a bin by rounding, which only an exchange with other groups wins back.)
    """
    bins = best_fit_decreasing(sizes, capacity)
    count = int(bins.max()) + 1 if len(bins) else 0
    gap = max(0, count - lower_bound(sizes, capacity))
    room = capacity - np.bincount(bins, sizes, count).astype(np.int64)
    order = np.argsort(-room, kind="stable")
    enough = int(np.searchsorted(np.cumsum(room[order]), 2 * (gap + 1) * capacity)) + 1
    given = np.zeros(count, bool)
    given[order[:enough]] = True
    return bins, given[bins] & (room[bins] > 0), gap == 0


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of every tokenised document: its ids, then ``end_id``, cut at capacity."""
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_encoder(tokenizer), np.array([end_id], "<u4")
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.texts(batch.column(1).to_pylist()), strict=True):
                ids = np.concatenate([ids.astype("<u4"), end])
                for k, start in enumerate(range(0, len(ids), capacity)):
                    some = ids[start : start + capacity]
                    for column, value in zip(rows, (doc_id, k, start, len(some), zlib.crc32(some.tobytes())), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(cut, PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, group_items: int = 8192, rounds: int = 6) -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` tokens.

    Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified
    (its group met its lower bound, or the piece fills a sequence).  Null text is
    empty: one token, ``end_id``.  Rows that repeat a doc_id are packed each; a null
    doc_id stays null; an empty table gives no rows; further columns are dropped.
    """
    pieces = written(token_pieces(docs, tokenizer, capacity, end_id).withColumn("uid", F.monotonically_increasing_id()))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = pieces.where(F.col("length") == capacity).select(*names, (F.col("uid") + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    left, packed = pieces.where(F.col("length") < capacity), [full]
    count = left.count()
    for number in range(rounds if count else 0):
        groups = -(-count // group_items)

        def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["length", "uid"], ascending=[False, True], kind="stable", ignore_index=True)
            bins, given, certified = pack_group(pdf["length"].to_numpy(), capacity)
            order = np.argsort(bins, kind="stable")
            ends = pdf["length"].to_numpy()[order].cumsum()
            begin = ends - pdf["length"].to_numpy()[order]
            first = np.flatnonzero(np.diff(bins[order], prepend=-1))
            offset = np.empty(len(pdf), np.int64)
            offset[order] = begin - np.repeat(begin[first], np.diff(np.append(first, len(order))))
            sequence = (np.int64(key[0]) << 56) + (np.int64(key[1]) << 24) + bins
            return pdf.assign(sequence_id=sequence, offset=offset, certified=certified, given=given)[[*names, "uid", "sequence_id", "offset", "certified", "given"]]

        dealt = left.withColumn("round", F.lit(number)).withColumn("group", F.pmod(F.xxhash64("uid", F.lit(number)), F.lit(groups)))
        done = written(dealt.groupBy("round", "group").applyInPandas(pack, f"{PIECES}, uid long, sequence_id long, offset long, certified boolean, given boolean"))
        given = done.where("given").count()
        if number == rounds - 1 or groups == 1 or given in (0, count):
            packed.append(done.drop("uid", "given"))
            break
        packed.append(done.where("not given").drop("uid", "given"))
        left, count = done.where("given").select(*names, "uid"), given
    out = packed[0]
    for more in packed[1:]:
        out = out.unionByName(more)
    return out
