"""Operator 8: token ids in files of fixed-width bit-packed blocks.

Every id takes the least number of bits that the vocabulary needs.  64 ids fill
exactly ``bits`` 64-bit words, so packing and unpacking are a few vectorised shifts
per column of a 64-column matrix.  A file is

    magic, bits, ids in a block | blocks | document index | block offsets | trailer

and the offsets allow reading the ids of one document without the rest.

The documents are range-partitioned and sorted by doc_id; each task writes one file
under a name of its own attempt, and a manifest committed by Spark names the files
that count, so a lost executor or a repeated task leaves no wrong file behind.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recoflow.llm.common import shared_dir, small_batches, texts
from recoflow.llm.tokenizers_io import byte_level_encoder, library

MAGIC = b"IDBLOCK1"
HEADER = struct.Struct("<8sII")
TRAILER = struct.Struct("<QQQQ8s")
#: Ids in a block, a multiple of 64.
BLOCK_IDS = 1 << 16


def width(vocabulary: int) -> int:
    """Bits for ids below ``vocabulary``, 1 at least."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids (below 2**bits, bits <= 32) as little-endian words; padded to 64 ids."""
    groups = -(-len(ids) // 64)
    lanes = np.zeros((groups, 64), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    words = np.zeros((groups, bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        words[:, word] |= lanes[:, j] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= lanes[:, j] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first n ids of ``pack``'s bytes."""
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    lanes = np.empty((len(words), 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        lane = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            lane = lane | words[:, word + 1] << np.uint64(64 - shift)
        lanes[:, j] = lane & mask
    return lanes.reshape(-1)[:n]


def file_system(uri: str):
    """(pyarrow file system, path) of a URI or a local path."""
    from pyarrow import fs

    if urlsplit(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlsplit(uri).path
    return fs.FileSystem.from_uri(uri)


class IdFileWriter:
    """Streams documents into one file; holds one block and the index in memory."""

    def __init__(self, uri: str, bits: int, block_ids: int = BLOCK_IDS):
        self.fs, self.path = file_system(uri)
        self.bits, self.block_ids = bits, block_ids
        self.out = self.fs.open_output_stream(self.path)
        self.out.write(HEADER.pack(MAGIC, bits, block_ids))
        self.rest, self.held = [], 0
        self.blocks, self.docs, self.ends = [HEADER.size], [], []
        self.n = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.held += len(ids)
        self.n += len(ids)
        self.docs.append(doc_id)
        self.ends.append(self.n)
        if self.held >= self.block_ids:
            every = np.concatenate(self.rest)
            whole = len(every) // self.block_ids * self.block_ids
            for i in range(0, whole, self.block_ids):
                self._block(every[i : i + self.block_ids])
            self.rest, self.held = [every[whole:]], len(every) - whole

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.blocks.append(self.blocks[-1] + len(data))

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.rest))
        known = np.array([d is not None for d in self.docs], np.uint8)
        self.out.write(np.array([d or 0 for d in self.docs], "<i8").tobytes() + known.tobytes())
        self.out.write(np.array([0, *self.ends], "<i8").tobytes() + np.array(self.blocks, "<u8").tobytes())
        self.out.write(TRAILER.pack(len(self.docs), len(self.blocks) - 1, self.n, self.blocks[-1], MAGIC))
        self.out.close()


class IdFile:
    """Random access to a written file."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        magic, self.bits, self.block_ids = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        docs, blocks, self.n, index, end = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC or end != MAGIC:
            raise ValueError(f"{uri} is no id file")
        data = self.file.read_at(size - TRAILER.size - index, index)
        doc_ids = np.frombuffer(data, "<i8", docs)
        known = np.frombuffer(data, np.uint8, docs, 8 * docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(doc_ids, known, strict=True)]
        self.starts = np.frombuffer(data, "<i8", docs + 1, 9 * docs)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, 9 * docs + 8 * (docs + 1))

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids number ``begin`` to ``end`` of the file, reading only their blocks."""
        if begin >= end:
            return np.zeros(0, np.uint32)
        first, last = begin // self.block_ids, (end - 1) // self.block_ids + 1
        low, high = int(self.offsets[first]), int(self.offsets[last])
        n = min(self.n, last * self.block_ids) - first * self.block_ids
        # whole blocks are multiples of 64 ids, so consecutive blocks unpack as one
        ids = unpack(self.file.read_at(high - low, low), n, self.bits)
        return ids[begin - first * self.block_ids : end - first * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def documents(self, at_once: int = 16 * BLOCK_IDS) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the file, ids) of every document, in order."""
        k = 0
        while k < len(self.doc_ids):
            stop = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + at_once, "right")) - 1)
            ids, base = self.ids(int(self.starts[k]), int(self.starts[stop])), int(self.starts[k])
            for i in range(k, stop):
                yield self.doc_ids[i], int(self.starts[i]), ids[self.starts[i] - base : self.starts[i + 1] - base]
            k = stop


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Encode documents and write their ids, in ascending doc_id order, as id files.

    docs: doc_id, text (null: empty).  A null doc_id sorts first; rows that repeat a
    doc_id are documents of their own, ordered by a hash of their text.  An empty
    table gives no file.  Returns the manifest: file, n_docs, n_ids, first_doc,
    partition.
    """
    spark = docs.sparkSession
    small_batches(spark)
    data = f"{folder}/data"
    fs, path = file_system(data)
    fs.create_dir(path, recursive=True)
    ordered = texts(docs).withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        encoder, bits = byte_level_encoder(tokenizer), width(library(tokenizer).get_vocab_size())
        file = f"{data}/part-{task.partitionId():06d}-{task.taskAttemptId()}.ids"
        writer, first, end = None, None, np.array([end_id], np.uint32)
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if rows and writer is None:
                writer, first = IdFileWriter(file, bits), ids[0]
            for doc_id, tokens in zip(ids, encoder.texts(rows), strict=True):
                writer.add(doc_id, np.concatenate([tokens, end]))
        if writer is not None:
            writer.close()
            row = {"file": [file], "n_docs": [len(writer.docs)], "n_ids": [writer.n], "first_doc": [first], "partition": [task.partitionId()]}
            yield pa.RecordBatch.from_pydict(row, pa.schema([("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_doc", pa.int64()), ("partition", pa.int64())]))

    ordered.mapInArrow(write, "file string, n_docs long, n_ids long, first_doc long, partition long").write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of a folder of id files: doc_id, start (ids before it), n_tokens,
    ids_crc32.  One task reads one file; the driver sees one manifest row per file."""
    files, start = [], 0
    for row in sorted(spark.read.parquet(f"{folder}/manifest").collect(), key=lambda r: r.partition):
        files.append((row.file, start))
        start += row.n_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                file, before = files[k]
                rows: tuple[list, list, list, list] = ([], [], [], [])
                for doc_id, begin, ids in IdFile(file).documents():
                    for column, value in zip(rows, (doc_id, before + begin, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, len(files))
    return spark.range(0, len(files), 1, n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def id_files(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Write the documents' ids as files and read them back (see ``read_ids``)."""
    folder = folder or shared_dir(docs.sparkSession)
    write_ids(docs, folder, tokenizer, end_id)
    return read_ids(docs.sparkSession, folder)
