"""Operator 6: near-duplicate documents by HyperMinHash.

A document's shingles fall into buckets by their hash; a bucket keeps its least hash
as a register of leading-zero count and mantissa bits.  Shingles are hashed anew,
round after round, for buckets still empty, so that small sets fill all registers
too, and two registers agree with the probability of the Jaccard similarity.

1. Documents with equal shingle sets form a class; one of them stands for it.
2. Bands of registers are hashed; classes that share a band are candidates.  In each
   band's group one pivot, the least member, is compared with all others.
3. Candidates pass a size test and a collision-corrected estimate of the similarity
   (its margin is six standard deviations), then the exact test on full sets.
4. Links give components by star contractions.  Groups whose members all lie in one
   component are done.  The members of the others meet by their rarest shingles
   (``rarest``, ``meeting``): a pair of the similarity asked for can't miss that, so
   every pair that shares a band is compared or known to be connected.  Pairs of one
   component are left out, the others go through estimate and exact test as in 3.
   Pages of one template below the similarity meet only where their own words do.

A band that a noticeable share of all classes has is dealt to many tasks (``spread_join``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recoflow.llm.common import small_batches, spread_join, whole_row, written
from recoflow.llm.components import components
from recoflow.llm.pieces import blocks
from recoflow.llm.shingles import GOLDEN, mix, shingle_sets

BANDS, ROWS = 40, 5
#: Larger sets that one part of a common shingle holds.
PART = 1024
REGISTERS = BANDS * ROWS
MANTISSA = 10
_EDGES = np.array([-(-(j << 64) // REGISTERS) for j in range(REGISTERS)], np.uint64)
_SEEDS = mix(np.arange(1, 4 * REGISTERS, dtype=np.uint64) * GOLDEN)


def _register(fraction: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa bits of numbers in [0, 1)."""
    mantissa, exponent = np.frexp(np.maximum(fraction, 2.0**-50))
    return (-exponent).astype(np.int64) << MANTISSA | ((mantissa * 2 - 1) * (1 << MANTISSA)).astype(np.int64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers (uint16) of a sorted, non-empty set of 64-bit hashes."""
    m = REGISTERS
    at = np.searchsorted(hashes, _EDGES)
    filled = at < np.append(at[1:], len(hashes))
    out = np.zeros(m, np.int64)
    out[filled] = _register((hashes[at[filled]] - _EDGES[filled]).astype(np.float64) * (m / 2.0**64))
    done, step = 0, max(1, -(-2 * m // len(hashes)))
    low = np.uint64(0xFFFFFFFF)
    while not filled.all() and done < 2 * m:
        step = min(step, 2 * m - done)
        x = mix(hashes[None, :] ^ _SEEDS[done : done + step, None])
        bucket = (x >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)
        order = np.sort((bucket << np.uint64(44) | np.arange(step, dtype=np.uint64)[:, None] << np.uint64(32) | x & low).ravel())
        empty = np.flatnonzero(~filled)
        at = np.searchsorted(order, empty.astype(np.uint64) << np.uint64(44))
        hit = at < len(order)
        hit[hit] = order[at[hit]] >> np.uint64(44) == empty[hit].astype(np.uint64)
        least = order[at[hit]]
        out[empty[hit]] = _register((least & low).astype(np.float64) / 2.0**32)
        filled[empty[hit]] = True
        done += step
    for j in np.flatnonzero(~filled):
        least = mix(hashes ^ _SEEDS[2 * m + j]).min()
        out[j] = _register(np.array([float(least) / 2.0**64]))[0]
    return out.astype(np.uint16)


def bands_of(registers: np.ndarray) -> np.ndarray:
    """One hash for each band of registers."""
    weights = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * GOLDEN)
    mixed = mix((registers.astype(np.uint64) + np.uint64(1)) * weights)
    return mix(mixed.reshape(BANDS, ROWS).sum(1) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def accidental(size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Probability that registers of unrelated sets agree, by their sizes: the sum over
    register values of the products of the two probabilities of holding it."""
    upper = 2.0 ** -np.arange(0, 40 / 4, 0.25)
    lower = 2.0 ** -np.arange(0.25, 40 / 4 + 0.25, 0.25)
    width = 2.0 ** -(np.floor(np.arange(0, 40 / 4, 0.25)) + 1 + MANTISSA)
    mass = []
    for size in (size_a, size_b):
        rate = np.maximum(np.asarray(size, np.float64) / REGISTERS, 1.0)[:, None]
        mass.append(np.exp(-rate * lower) - np.exp(-rate * upper))
    return (mass[0] * mass[1] * width / (upper - lower)).sum(1)


def estimate(regs_a: np.ndarray, regs_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers (rows), corrected for accidental agreement."""
    chance = accidental(size_a, size_b)
    return ((regs_a == regs_b).mean(1) - chance) / (1 - chance)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """Per row: doc_id, row (hash of the text), n, s1, s2 (hashes of the shingle set),
    bands and registers (null for an empty set)."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, row long, n long, s1 long, s2 long, bands array<long>, registers binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2).to_pylist()
            n, s1, s2, bands, registers = [], [], [], [], []
            for a, b in blocks(rows):
                for hashes in shingle_sets(rows[a:b], width):
                    n.append(len(hashes))
                    s1.append(int(mix(hashes ^ _SEEDS[0]).sum().view(np.int64)))
                    s2.append(int(mix(hashes ^ _SEEDS[1]).sum().view(np.int64)))
                    found = sketch(hashes) if len(hashes) else None
                    registers.append(None if found is None else found.tobytes())
                    bands.append(None if found is None else bands_of(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(registers, pa.binary())], ["doc_id", "row", "n", "s1", "s2", "bands", "registers"])

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("row"), text.alias("text")).mapInArrow(run, schema)


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """uid, hashes (array of long) for the rows of ``wanted`` (uid, doc_id, row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist()
            sets = [s.view(np.int64) for a, b in blocks(rows) for s in shingle_sets(rows[a:b], width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["uid", "hashes"])

    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").alias("d"), F.xxhash64(text).alias("r"), text.alias("text"))
    found = wanted.join(keyed, wanted["doc_id"].eqNullSafe(keyed["d"]) & (wanted["row"] == keyed["r"])).select("uid", "text")
    return found.mapInArrow(run, "uid long, hashes array<long>")


def _similar_size(a: Column, b: Column, percent: int) -> Column:
    return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose estimate allows the similarity asked for."""
    wanted = percent / 100
    least = wanted - 6 * (wanted * (1 - wanted) / REGISTERS) ** 0.5
    for side in ("u", "v"):
        pairs = pairs.join(classes.select(F.col("uid").alias(side), F.col("n").alias(f"n_{side}"), F.col("registers").alias(f"r_{side}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            t = {c: batch.column(c) for c in ("u", "v", "n_u", "n_v", "r_u", "r_v")}
            regs = [np.frombuffer(b"".join(t[c].to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("r_u", "r_v")]
            keep = estimate(*regs, t["n_u"].to_numpy(), t["n_v"].to_numpy()) >= least
            yield pa.RecordBatch.from_arrays([t["u"], t["v"]], ["u", "v"]).filter(pa.array(keep))

    return pairs.mapInArrow(run, "u long, v long")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) that the full sets confirm."""
    both = pairs.join(sets.toDF("v", "s_v"), "v").join(sets.toDF("u", "s_u"), "u")
    shared = F.size(F.array_intersect("s_u", "s_v"))
    either = F.size("s_u") + F.size("s_v") - shared
    return both.where(shared * 100 >= either * percent).select("u", "v")


def rarest(sets: DataFrame, percent: int) -> DataFrame:
    """The shingles by which sets that reach the similarity must meet: uid, label, n, h, df
    (sets that have h), pos (place of h in its set, rarest first, from 0).

    sets: uid, label, n, hashes; a written table.  Sets of n shingles that reach it share
    at least percent % of n, so one of the first n - that + 1 places of each.  Shingles
    of one set alone come first and are only counted.
    """
    tokens = sets.select("uid", "label", "n", F.explode("hashes").alias("h"))
    often = written(tokens.groupBy("h").agg(F.count("*").alias("df")).where(F.col("df") > 1))
    total = often.agg(F.sum("df")).first()[0] or 0
    common = spread_join(tokens, often, "h", "uid", often.select("h", F.col("df").alias("n")), total)
    ranked = common.groupBy("uid", "label", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("common"))
    alone = F.col("n") - F.size("common")
    reach = F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1
    first = F.slice("common", F.lit(1), F.greatest(F.lit(0), reach - alone).cast("int"))
    return ranked.select("uid", "label", "n", alone.alias("alone"), F.posexplode(first)).select("uid", "label", "n", "col.h", "col.df", (F.col("alone") + F.col("pos")).alias("pos"))


def meeting(rare: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of different labels that share one of their rarest shingles and could
    still reach the similarity.

    The larger set comes with all places that ``rarest`` gives, the smaller one with those
    that suffice for partners of its size or more (n less 2 p / (1 + p) of n, plus 1).
    Of two sets below the similarity that have only common passages, the smaller one's
    places are filled by what is its own.  A shingle that many sets have is dealt into
    parts of about PART larger sets; the smaller ones go to all its parts.
    """
    parts = F.ceil(F.col("df") / PART).cast("int")
    reach = F.col("n") - F.expr(f"(2 * {percent} * n + {99 + percent}) div {100 + percent}") + 1
    large = rare.select("h", F.pmod(F.xxhash64("uid"), parts).cast("int").alias("part"), *[F.col(c).alias(f"{c}_u") for c in ("uid", "label", "n", "pos")])
    small = rare.where(F.col("pos") < reach).select("h", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), *[F.col(c).alias(f"{c}_v") for c in ("uid", "label", "n", "pos")])
    ordered = F.struct("n_v", "uid_v") < F.struct("n_u", "uid_u")
    least = F.expr(f"({percent} * (n_u + n_v) + {99 + percent}) div {100 + percent}")
    enough = F.least(F.col("n_u") - F.col("pos_u"), F.col("n_v") - F.col("pos_v")) >= least
    both = large.join(small, ["h", "part"]).where(ordered & (F.col("label_u") != F.col("label_v")) & _similar_size(F.col("n_u"), F.col("n_v"), percent) & enough)
    return both.select(F.col("uid_u").alias("u"), F.col("uid_v").alias("v")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, row (hash of its text), n_shingles, component_id (the
    smallest doc_id it reaches by links), kept (doc_id = component_id), class_id (rows of
    equal shingle sets share it).

    Two rows are linked if 100 * |A & B| >= percent * |A | B| on their sets of
    ``width``-word shingles.  Null and empty texts have an empty set and no link.  Rows
    that repeat a doc_id are documents of their own; a null doc_id counts as larger
    than all others.  Further columns are dropped; an empty table gives no rows.  A text
    is cut into words in one task, so memory grows with the longest text only.
    """
    every = written(sketches(docs, width).withColumn("uid", F.monotonically_increasing_id()))
    empty = F.col("n") == 0
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "uid")
    classes = every.where(~empty).groupBy("n", "s1", "s2").agg(F.min(order).alias("least"))
    classes = written(classes.select("n", "s1", "s2", F.col("least.uid").alias("uid"), F.col("least.doc_id").alias("doc_id")))
    rows = written(every.where(~empty).join(classes.select("uid"), "uid", "left_semi").select("uid", "doc_id", "row", "n", "bands", "registers"))
    wanted = lambda uids: rows.select("uid", "doc_id", "row").join(uids, "uid", "left_semi")

    in_band = rows.select(F.explode("bands").alias("key"), "uid", "n")
    shared = written(in_band.groupBy("key").agg(F.min("uid").alias("pivot"), F.count("*").alias("size")).where(F.col("size") > 1))
    total = shared.agg(F.sum("size")).first()[0] or 0
    members = written(spread_join(in_band, shared, "key", "uid", shared.select("key", F.col("size").alias("n")), total))
    first = members.where(F.col("uid") != F.col("pivot")).select(F.col("pivot").alias("u"), F.col("uid").alias("v"), "n").distinct()
    first = first.join(rows.select(F.col("uid").alias("u"), F.col("n").alias("n_pivot")), "u").where(_similar_size(F.col("n"), F.col("n_pivot"), percent))
    pairs = written(likely(first.select("u", "v"), rows, percent))
    sets = written(full_sets(docs, wanted(pairs.select(F.explode(F.array("u", "v")).alias("uid")).distinct()), width).dropDuplicates(["uid"]))
    stars = components(linked(pairs, sets, percent))

    # groups of two have been compared; of larger ones, those with two components are left
    labels = members.where(F.col("size") > 2).join(stars.toDF("uid", "label"), "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    mixed = labels.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where(F.col("a") != F.col("b")).select("key")
    left = written(labels.join(mixed, "key", "left_semi").select("uid", "label").distinct())
    late = full_sets(docs, wanted(left.select("uid")).join(sets.select("uid"), "uid", "left_anti"), width).dropDuplicates(["uid"])
    sets = sets.join(left.select("uid"), "uid", "left_semi").unionByName(late)
    sets = written(sets.join(left, "uid").select("uid", "label", F.size("hashes").alias("n"), "hashes"))
    pairs = written(likely(meeting(rarest(sets, percent), percent), rows, percent))
    more = linked(pairs, sets.select("uid", "hashes"), percent)
    stars = components(stars.union(more))

    label = classes.select(F.col("uid").alias("class_id"), "doc_id", "n", "s1", "s2").join(stars.toDF("class_id", "label"), "class_id", "left").withColumn("label", F.coalesce("label", "class_id"))
    least = label.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    label = label.join(least, "label").select("class_id", "component_id", "n", "s1", "s2")
    full = every.where(~empty).select("doc_id", "row", "n", "s1", "s2").join(label, ["n", "s1", "s2"])
    alone = every.where(empty).select("doc_id", "row", "n", F.col("uid").alias("class_id"), F.col("doc_id").alias("component_id"))
    out = full.select(alone.columns).unionByName(alone)
    return out.select("doc_id", "row", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "class_id")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns; of
    rows equal in doc_id and text one stays."""
    doc, row = F.coalesce("doc_id", F.lit(2**63 - 1)), F.xxhash64(F.coalesce("text", F.lit("")))
    kept = near_duplicates(docs, width, percent).where("kept").select(doc.alias("doc"), "row")
    keyed = docs.select(doc.alias("doc"), row.alias("row"), whole_row(docs, "whole"))
    single = keyed.join(kept, ["doc", "row"], "left_semi").dropDuplicates(["doc", "row"])
    return single.select(*[F.col(f"whole.`{c}`") for c in docs.columns])
