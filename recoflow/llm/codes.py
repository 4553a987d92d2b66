"""Operator 13: vector code compression (product quantisation) in exact integers.

Components become integers floor(1024 x); vectors are cut into equal parts, and each
part position has a codebook that a few rounds of assignment and averaging refine.
Distances are exact: |v - e|^2 = |v|^2 - 2 v.e + |e|^2, where the inner products of a
batch with a codebook are float64 matrix products of limbs.  Integers are broken into
limbs so narrow that every sum of such a product stays below 2^53 and thus is exact; the
products of limb pairs are shifted and added in int64, and the first argmin is the code.

A codebook has a fixed number of entries, so it is sent to all tasks.  A round sends one
row of sums an entry and task to the shuffle, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflow.llm.common import written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integer components stay below this magnitude, so that distances fit 64 bits.
LARGEST = 1 << 26
#: Rows whose distances to a codebook are held at once.
BLOCK = 4096


def limb_bits(width: int) -> int:
    """Bits of a limb: ``width`` products of two limbs add up to less than 2^53."""
    return (52 - max(0, int(width) - 1).bit_length()) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """float64 limbs of an int64 array, lowest first: the sum of limb t times 2^(bits t) is
    x.  The last one is signed, the others are not; as many as the largest number needs."""
    out = []
    while x.size and max(int(x.max()), -int(x.min())) >= 1 << bits:
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def exact_products(a: np.ndarray, b: np.ndarray, bits: int | None = None) -> np.ndarray:
    """a @ b.T of int64 matrices, exact wherever it fits 64 bits."""
    bits = bits or limb_bits(a.shape[1])
    out = np.zeros((len(a), len(b)), np.int64)
    right = [y.T for y in limbs(b, bits)]
    for s, x in enumerate(limbs(a, bits)):
        for t, y in enumerate(right):
            out += (x @ y).astype(np.int64) << (bits * (s + t))
    return out


def nearest_entries(v: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first nearest entry of each row, and its squared distance."""
    d = (book * book).sum(1) - 2 * exact_products(v, book)
    code = d.argmin(1)
    return code, d[np.arange(len(v)), code] + (v * v).sum(1)


def assigned(v: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x parts) and squared distances summed over parts of whole vectors; books
    has the entries of each part."""
    codes, errors = np.zeros((len(v), len(books)), np.int64), np.zeros(len(v), np.int64)
    width = books.shape[2]
    for a in range(0, len(v), BLOCK):
        for p, book in enumerate(books):
            codes[a : a + BLOCK, p], d = nearest_entries(v[a : a + BLOCK, p * width : (p + 1) * width], book)
            errors[a : a + BLOCK] += d
    return codes, errors


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("v"))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(batch), -1)


def _entry_sums(books: np.ndarray):
    """Function of batches: slot (part and entry), n, and the sums of its parts, one row a
    slot and task."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            v = _matrix(batch)
            codes, _ = assigned(v, books)
            for p in range(parts):
                np.add.at(sums, p * entries + codes[:, p], v[:, p * width : (p + 1) * width])
                n += np.bincount(p * entries + codes[:, p], minlength=len(n))
        used = np.flatnonzero(n)
        columns = [used, n[used], *sums[used].T]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["slot", "n", *(f"s{k}" for k in range(width))])

    return run


def codebooks(ready: DataFrame, first: np.ndarray, rounds: int) -> np.ndarray:
    """The entries (parts x entries x width) after so many rounds of assignment and
    componentwise floor of the mean; entries without vectors stay."""
    books = first
    parts, entries, width = books.shape
    names = [f"s{k}" for k in range(width)]
    kinds = ", ".join(f"{c} long" for c in ("slot", "n", *names))
    for _ in range(rounds):
        sums = ready.select("v").mapInArrow(_entry_sums(books), kinds).groupBy("slot").agg(*[F.sum(c).alias(c) for c in ("n", *names)])
        books = books.reshape(-1, width).copy()
        for slot, n, *s in sums.collect():  # at most parts * entries rows
            books[slot] = np.array(s, np.int64) // n
        books = books.reshape(parts, entries, width)
    return books


def integer_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, v: floor(scale x) of the components as integers; vectors that are null
    or hold a null or non-finite component are left out."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("long").alias("label")
    kept = vectors.select("vec_id", label, x.alias("x")).where(F.col("x").isNotNull() & fine)
    fits = F.when(F.forall("x", lambda c: F.abs(c * scale) < LARGEST), F.col("x"))
    loud = F.coalesce(fits, F.raise_error(F.lit(f"a component times {scale} is {LARGEST} or more: distances would not fit 64 bits")))
    return kept.select("vec_id", "label", F.transform(loud, lambda c: F.floor(c * scale).cast("int")).alias("v"))


CODED = "code string, error long, label_error long, codebooks_sha256 string"


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable vector.

    vectors: vec_id, embedding and, optionally, label; further columns are dropped.  The
    codebooks begin as the parts of the ``entries`` smallest vec_ids (all, if there are
    fewer; rows of one vec_id in order of their vectors, a null vec_id first).  code has
    two hex digits a part, error is the squared distance to the entries, label_error its
    sum over the rows of equal label, where nulls are one label.  Vectors of another number
    of components than the smallest vec_id's take no part, as unusable ones do; that
    number must be a multiple of ``parts``.  Equal rows stay rows of their own; a table
    without usable vectors gives no rows.  Raises where components are so large that
    distances would not fit 64 bits.
    """
    spark = vectors.sparkSession
    ready = written(integer_vectors(vectors, scale))
    head = [row[0] for row in ready.orderBy("vec_id", "v").limit(entries).select("v").collect()]
    id_type = ready.schema["vec_id"].dataType.simpleString()
    if not head:
        return spark.createDataFrame([], f"vec_id {id_type}, {CODED}")
    size = len(head[0])
    if not size or size % parts or entries > 256:
        raise ValueError(f"vectors of {size} components can't be cut into {parts} equal parts of {entries} entries")
    ready = ready.where(F.size("v") == size)
    begin = np.array([v for v in head if len(v) == size], np.int64)
    if len(begin) < len(head):
        begin = np.array([row[0] for row in ready.orderBy("vec_id", "v").limit(entries).select("v").collect()], np.int64)
    books = codebooks(ready, np.ascontiguousarray(begin.reshape(len(begin), parts, -1).swapaxes(0, 1)), rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = assigned(_matrix(batch), books) if len(batch) else (np.zeros((0, parts), np.int64), np.zeros(0, np.int64))
            text = [bytes(row).hex() for row in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    label_type = ready.schema["label"].dataType.simpleString()
    coded = written(ready.mapInArrow(encode, f"vec_id {id_type}, label {label_type}, code string, error long"))
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    step = f"""
a{{i}} AS MATERIALIZED (
  SELECT p.rid, p.part, any_value(p.x) AS x, arg_min(b.e, (list_inner_product(b.x, b.x) - 2 * list_inner_product(p.x, b.x)) * {entries} + b.e) AS e,
         min(list_inner_product(b.x, b.x) - 2 * list_inner_product(p.x, b.x)) + list_inner_product(any_value(p.x), any_value(p.x)) AS d
  FROM p JOIN b{{i}} b USING (part) GROUP BY p.rid, p.part
)"""
    move = """
s{i} AS MATERIALIZED (
  SELECT part, e, list(m ORDER BY pos) AS x FROM (
    SELECT part, e, pos, floor(sum(c) / count(*)) AS m FROM (SELECT part, e, generate_subscripts(x, 1) AS pos, unnest(x) AS c FROM a{i}) GROUP BY part, e, pos) GROUP BY part, e
), b{j} AS MATERIALIZED (SELECT b.part, b.e, coalesce(s.x, b.x) AS x FROM b{i} b LEFT JOIN s{i} s USING (part, e))"""
    chain = ",".join(step.format(i=i) + "," + move.format(i=i, j=i + 1) for i in range(rounds)) + "," + step.format(i=rounds)
    return f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS FIRST, embedding) AS rid, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT rid, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS x FROM k, (SELECT unnest(range({parts})) AS part)
), b0 AS MATERIALIZED (SELECT part, rid - 1 AS e, x FROM p WHERE rid <= {entries}),{chain},
h AS (SELECT sha256(string_agg(list_aggregate(list_transform(x, lambda c: c::BIGINT::VARCHAR), 'string_agg', ','), ',' ORDER BY part, e)) AS h FROM b{rounds}),
c AS (SELECT rid, string_agg(format('{{:02x}}', e::INT), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM c JOIN k USING (rid), h
"""


ORACLE = _oracle()
