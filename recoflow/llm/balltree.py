"""Operator 1: exact top-k inner products by ball trees.

Candidates are dealt to shards of bounded size.  A task builds a ball tree over a shard,
once, and the queries stream past it in batches.  Every query opens the tree's nodes best
first, in the order of their upper bound q.c + |q| r, and stops when no bound can beat its
current k-th score, which improves with every leaf that it reads.

Shards are searched in rounds, each with more shards than the one before; all queries take
the k-th score that they have reached into the next round and begin their pruning there.

Vectors are made of integers, floor(256 x), so scores are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recoflow.llm.common import written

LEAF = 128
#: Queries that search a tree in step.
QUERIES = 1024


class BallTree:
    """Nodes are halves of halves of the points, along the direction in which they
    spread most; split by position, so equal points part too."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        order = np.arange(len(points))
        self.bounds, left, spans = [], [], [(0, len(points))]
        k = 0
        while k < len(spans):
            low, high = spans[k]
            self.bounds.append((low, high))
            if high - low > LEAF:
                some = points[order[low:high]]
                axis = some - some.mean(0)
                far = axis[np.argmax((axis**2).sum(1))]
                half = (high - low) // 2
                parts = np.argpartition(axis @ far, half)
                order[low:high] = order[low:high][parts]
                left.append(len(spans))
                spans += [(low, low + half), (low + half, high)]
            else:
                left.append(0)
            k += 1
        self.points, self.ids, self.rows = points[order], ids[order], rows[order]
        self.left = np.array(left)  #: first child (the second follows it); 0 for leaves
        self.read = 0  #: nodes that queries have opened
        self.centres = np.stack([self.points[a:b].mean(0) for a, b in self.bounds])
        self.radii = np.array([np.sqrt(((self.points[a:b] - c) ** 2).sum(1).max()) for (a, b), c in zip(self.bounds, self.centres, strict=True)])
        self.least = np.array([self.ids[a:b].min() for a, b in self.bounds])

    def bound(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Largest integer scores that points of the nodes can reach."""
        reach = queries @ self.centres[nodes].T + np.sqrt((queries**2).sum(1))[:, None] * self.radii[nodes]
        return np.floor(reach + 1e-6 * (1 + np.abs(reach)))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, score: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, id, score) of the best k points of each query, its own row left
        out, that beat, or tie and have a smaller id than, the given k-th ``score`` (minus
        infinity: none) with id ``at``."""
        n, every = len(queries), np.arange(len(queries))
        limits = self.bound(queries, np.arange(len(self.bounds)))
        bounds = np.full_like(limits, -np.inf)  # of the open nodes
        bounds[:, 0] = limits[:, 0]
        best, ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        while True:
            useful = (bounds > score[:, None]) | ((bounds == score[:, None]) & (bounds > -np.inf) & (self.least < at[:, None]))
            node = np.where(useful, bounds, -np.inf).argmax(1)
            going = np.flatnonzero(useful[every, node])
            if not len(going):
                break
            node = node[going]
            bounds[going, node] = -np.inf
            self.read += len(going)
            inner = self.left[node] > 0
            for child in (self.left[node[inner]], self.left[node[inner]] + 1):
                bounds[going[inner], child] = limits[going[inner], child]
            q, leaf = going[~inner], node[~inner]
            q, leaf = q[np.argsort(leaf, kind="stable")], np.sort(leaf)
            starts = np.flatnonzero(np.diff(leaf, prepend=-1))
            for x, part in zip(leaf[starts].tolist(), np.split(q, starts[1:]), strict=False):
                self._read_leaf(x, part, queries, own, best, ids, score, at)
        r, c = np.nonzero(best > -np.inf)
        return r, ids[r, c], best[r, c].astype(np.int64)

    def _read_leaf(self, x: int, q: np.ndarray, queries: np.ndarray, own: np.ndarray, best: np.ndarray, ids: np.ndarray, score: np.ndarray, at: np.ndarray) -> None:
        """Take the points of leaf x into the best ones of the queries numbered q."""
        a, b = self.bounds[x]
        got = queries[q] @ self.points[a:b].T
        got[self.rows[a:b] == own[q, None]] = -np.inf
        hit = (got >= score[q, None]).any(1)
        if not hit.any():
            return
        q, got = q[hit], got[hit]
        all_scores = np.concatenate([best[q], got], 1)
        all_ids = np.concatenate([ids[q], np.broadcast_to(self.ids[a:b], got.shape)], 1)
        first = np.lexsort((all_ids, -all_scores), 1)[:, : best.shape[1]]
        best[q], ids[q] = np.take_along_axis(all_scores, first, 1), np.take_along_axis(all_ids, first, 1)
        # the k-th score is the given one until k better points are found
        s, i = best[q, -1], ids[q, -1]
        better = (s > score[q]) | ((s == score[q]) & (i < at[q]))
        score[q[better]], at[q[better]] = s[better], i[better]


FOUND = "uid long, query_id long, vec_id long, score long"


def _search_shards(k: int):
    """Function of the sorted rows of some shards: of each, first its candidates, which
    are held and made into trees (one for each number of components), then its queries."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, trees = None, [], None
        for batch in batches:
            t = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "asks", "uid", "vec_id", "v", "kth", "kth_id")}
            ends = np.append(np.flatnonzero((np.diff(t["shard"]) != 0) | (np.diff(t["asks"].astype(np.int8)) != 0)) + 1, len(batch))
            begin = 0
            for end in ends.tolist():
                part = {c: x[begin:end] for c, x in t.items()}
                begin = end
                if not len(part["shard"]):
                    continue
                if part["shard"][0] != shard:
                    shard, held, trees = part["shard"][0], [], None
                if not part["asks"][0]:
                    held.append(part)
                    continue
                if trees is None:
                    trees = {}
                    if held:
                        v, ids, rows = (np.concatenate([h[c] for h in held]) for c in ("v", "vec_id", "uid"))
                        sizes = np.fromiter(map(len, v), np.int64, len(v))
                        trees = {d: BallTree(np.stack(v[sizes == d]).astype(np.float64), ids[sizes == d], rows[sizes == d]) for d in np.unique(sizes).tolist()}
                    held = []
                sizes = np.fromiter(map(len, part["v"]), np.int64, len(part["v"]))
                for d in np.unique(sizes).tolist():
                    where = np.flatnonzero(sizes == d)
                    for i in range(0, len(where) if d in trees else 0, QUERIES):
                        q = where[i : i + QUERIES]
                        kth = part["kth"][q].astype(np.float64)
                        known = ~np.isnan(kth)
                        at = np.where(known, part["kth_id"][q], 0).astype(np.int64)
                        r, ids, scores = trees[d].search(np.stack(part["v"][q]).astype(np.float64), part["uid"][q], k, np.where(known, kth, -np.inf), at)
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (part["uid"][q][r], part["vec_id"][q][r], ids, scores)], ["uid", "query_id", "vec_id", "score"])

    return search


def integer_vectors(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """vec_id, v: floor(256 x) of the components; vectors that are null or hold a null or
    non-finite component are left out."""
    x = F.transform(embedding, lambda c: c.cast("double"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    found = vectors.select("vec_id", x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & fine)
    return found.select("vec_id", F.transform("x", lambda c: F.floor(c * 256).cast("double")).alias("v"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, shard_rows: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows of each query row.

    vectors: vec_id, embedding.  Ties go to the smaller vec_id; a query with fewer
    candidates gets them all.  Rows without vec_id or with unusable vectors take no part;
    a query meets candidates of its own number of components only (an empty vector has a
    score of 0 with other empty ones).  Rows that repeat a vec_id are rows of their own:
    each is a query and a candidate of all other rows, those of the same vec_id too.
    Further columns are dropped; an empty table gives no rows.  Scores are exact while
    they stay below 2**53.  A task holds one shard and a batch of queries.
    """
    spark = vectors.sparkSession
    ready = written(integer_vectors(vectors).withColumn("uid", F.monotonically_increasing_id()))
    shards = max(1, -(-ready.count() // shard_rows))
    none = F.lit(None).cast("long")
    dealt = ready.select(F.pmod(F.xxhash64("uid"), F.lit(shards)).alias("shard"), F.lit(False).alias("asks"), "uid", "vec_id", "v", none.alias("kth"), none.alias("kth_id"))
    asked = written(ready.where(is_query).select("uid", "vec_id", "v"))
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    best = spark.createDataFrame([], FOUND)
    low, width = 0, max(1, shards // 8)
    while low < shards:
        high = min(shards, low + width)
        kth = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("uid", F.col("score").alias("kth"), F.col("vec_id").alias("kth_id"))
        every = F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high - 1).cast("long"))).alias("shard")
        queries = asked.join(kth, "uid", "left").select(every, F.lit(True).alias("asks"), "uid", "vec_id", "v", "kth", "kth_id")
        both = dealt.where(F.col("shard").between(low, high - 1)).unionByName(queries)
        found = both.repartition(high - low, "shard").sortWithinPartitions("shard", "asks").mapInArrow(_search_shards(k), FOUND)
        best = written(best.unionByName(found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"))
        low, width = high, 2 * width
    out = best.withColumn("rank", F.row_number().over(order))
    return out.select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
