"""Cell index: exact with pruning, and recall when probing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recoflow.operators import vectors
from recoflow.operators.blocks import CellIndex

SF = "/root/testdata/sf0.1"


def clustered(seed, n, dims=16, centres=12, spread=0.05):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(centres, dims))
    points = base[rng.integers(centres, size=n)] / np.sqrt(dims) + rng.normal(size=(n, dims)) * spread
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def frame(spark, points, name):
    return spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], f"{name} long, vector array<double>")


@pytest.mark.parametrize("block", [7, 2048])
def test_pruned_search_finds_every_pair(spark, block):
    a, b = clustered(1, 150), clustered(1, 400)
    b[5] = b[9]
    queries, items = frame(spark, a, "query_id"), frame(spark, b, "item_id").union(spark.createDataFrame([(999, None)], "item_id long, vector array<double>"))
    index = CellIndex(items, block=block)
    got = {(r["query_id"], r["item_id"]): r["cos"] for r in index.search(queries, 0.8).collect()}
    product = a @ b.T
    assert set(got) == set(zip(*(x.tolist() for x in np.nonzero(product >= 0.8)), strict=True))
    assert all(abs(product[q, i] - c) < 1e-9 for (q, i), c in got.items())
    sent, every = index.pruning(queries, 0.8)
    assert sent < 0.4 * every
    best = sorted(map(tuple, vectors.nearest(queries, items, 5, block).select("query_id", "rank", "item_id").collect()))
    assert best == [(q, r + 1, int(i)) for q in range(150) for r, i in enumerate(np.lexsort((np.arange(400), -product[q]))[:5])]


def test_plan_copies_no_items_and_counts_nothing_first(spark):
    items = frame(spark, clustered(2, 300), "item_id")
    found = vectors.above(items.withColumnRenamed("item_id", "query_id"), items, 0.9)
    plan = found._jdf.queryExecution().toString()
    assert "Join" not in plan and plan.count("Generate") == 0


def test_recall_of_probing_on_the_given_vectors(spark):
    items = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    asked = items.withColumnRenamed("item_id", "query_id").where("query_id % 20 = 0")
    other = F.col("query_id") != F.col("item_id")
    true, found = vectors.above(asked, items, 0.25).where(other), vectors.approximate(asked, items, 0.25).where(other)
    assert true.count() > 1000
    assert vectors.recall(found, true) >= 0.9
    assert found.join(true, ["query_id", "item_id"], "left_anti").count() == 0
    sent, every = CellIndex(items).pruning(asked, 0.25, 0.97)
    assert sent < every


def test_recall_of_probing_on_clusters(spark):
    asked, items = frame(spark, clustered(6, 60, spread=0.15), "query_id"), frame(spark, clustered(6, 3000, spread=0.15), "item_id")
    index = CellIndex(items, block=100)
    true = index.search(asked, 0.85)
    assert vectors.recall(index.search(asked, 0.85, target=0.97), true) >= 0.9
    assert index.pruning(asked, 0.85, 0.97)[0] < 0.5 * index.pruning(asked, 0.85)[0]


def test_nothing_to_search(spark):
    none = spark.createDataFrame([], "item_id long, vector array<double>")
    some = frame(spark, clustered(3, 4), "query_id")
    assert vectors.above(some, none, 0.5).collect() == []
    assert vectors.above(some.limit(0), frame(spark, clustered(3, 4), "item_id"), 0.5).collect() == []
    assert vectors.recall(none.selectExpr("item_id query_id", "item_id"), none.selectExpr("item_id query_id", "item_id")) == 1.0


def test_text_vectors(spark):
    texts = [(1, "red green red"), (2, "Red, GREEN red!"), (3, "blue"), (4, None), (5, "green red blue blue")]
    found = {r["k"]: np.array(r["vector"]) for r in vectors.embed(spark.createDataFrame(texts, "k long, text string"), "k", "text", 64).collect()}
    assert np.allclose(found[1], found[2]) and all(abs(np.linalg.norm(found[k]) - 1) < 1e-9 for k in (1, 3, 5)) and not found[4].any()
    assert found[5] @ found[3] > found[5] @ found[1] > 0 and abs(found[1] @ found[3]) < 1e-9
    # weight: count times the logarithm of (documents + 1) over (documents with the word + 1)
    red, green = 2 * np.log(6 / 4), np.log(6 / 4)
    assert np.allclose(sorted(found[1][found[1] > 0]), sorted([green, red] / np.hypot(green, red)))


def test_seeds_are_averaged_in_one_space(spark):
    rng = np.random.default_rng(2)
    docs, asked = {i: rng.normal(size=4) for i in range(6)}, {i: rng.normal(size=4) for i in (0, 1, 2, 4)}
    frame = lambda v: spark.createDataFrame([(i, list(map(float, x))) for i, x in v.items()], "item_id long, vector array<double>")
    seeds = spark.createDataFrame([("a", 0), ("a", 1), ("a", 3), ("b", 3), ("c", 99)], "query_id string, item_id long")

    def mean(space, ids):
        m = np.mean([space[i] / np.linalg.norm(space[i]) for i in ids if i in space], axis=0)
        return m / np.linalg.norm(m)

    got = {r.query_id: r.vector for r in vectors.seed_average(seeds, vectors.seed_space(frame(asked), frame(docs))).collect()}
    assert set(got) == {"a"} and np.allclose(got["a"], mean(asked, [0, 1]))  # b's seed has no query vector
    got = {r.query_id: r.vector for r in vectors.seed_average(seeds, vectors.seed_space(frame({}), frame(docs))).collect()}
    assert set(got) == {"a", "b"} and np.allclose(got["a"], mean(docs, [0, 1, 3])) and np.allclose(got["b"], mean(docs, [3]))
    less = {r.item_id: r.vector for r in vectors.centred(frame(docs)).collect()}
    assert np.allclose([less[i] for i in range(6)], np.array([docs[i] for i in range(6)]) - np.mean(list(docs.values()), axis=0))
