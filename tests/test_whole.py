"""Queries read their whole input: tables that a cut by id, place or share would shorten."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from recoflow.operators import filters, ranking
from recoflow.plans import fixtures
from recoflow.plans.retrieval import facts, pool

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def run(spark, name, sf):
    return driver.queries()[name](spark, str(sf)).collect()


def test_plays_of_all_customers(spark, tmp_path):
    spark.createDataFrame([(1, 7, "O"), (2, 150, "O"), (3, 9000, "O"), (4, 9001, "F")], "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 5), (2, 205), (2, 105), (3, 6), (4, 6)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = fixtures.frame(spark, str(tmp_path), "plays").collect()
    assert sorted(map(tuple, got)) == [("u150", 5), ("u7", 5), ("u9000", 6)]


def test_truth_is_every_other_item_of_the_label(spark):
    """Metrics of the blended ranking against all pairs of equal label by brute force."""
    import math

    from recoflow.plans.retrieval import scored

    label = {r.vec_id: r.label for r in fixtures.table(spark, SF, "embeddings").select("vec_id", "label").collect()}
    rank = {}
    for r in sorted(scored(spark, SF).collect(), key=lambda r: (-r.score, r.item_id)):
        rank.setdefault(r.query_id, []).append(r.item_id)
    got = {r.query_id: (r.recall_10, r.ndcg_10, r.rr) for r in run(spark, "k02_query_metrics", SF)}
    assert set(got) == set(rank)
    for q, items in rank.items():
        n = sum(v == label[q] for v in label.values()) - 1
        at = [i for i, x in enumerate(items[:10], 1) if label[x] == label[q]]
        want = (len(at) / n, sum(1 / math.log2(i + 1) for i in at) / sum(1 / math.log2(i + 1) for i in range(1, min(n, 10) + 1)), 1 / at[0] if at else 0)
        assert got[q] == pytest.approx(want, abs=2e-6)


@pytest.fixture(scope="module")
def dense(spark, tmp_path_factory):
    """90 items of one vector, so each has 89 candidates in order of id; only the last ten
    are of genre b."""
    path = tmp_path_factory.mktemp("dense")
    for t in ("supplier", "orders", "lineitem", "events", "customer"):
        os.symlink(f"{SF}/{t}.parquet", path / f"{t}.parquet")
    genre = F.when(F.col("p_partkey") >= 180, "b").otherwise("a")
    fixtures.table(spark, SF, "part").withColumn("p_type", genre).write.parquet(f"{path}/part.parquet")
    spark.range(100, 190).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("embedding"), F.lit(0).alias("label")).write.parquet(f"{path}/embeddings.parquet")
    return path


def test_long_pools_stay_whole(spark, dense):
    ids = set(range(100, 190))
    off = [r for r in run(spark, "f05_cap_off", dense) if r.query_id % 2 == 0]
    assert sorted((r.query_id, r.item_id) for r in off) == sorted((q, i) for q in ids if q % 2 == 0 for i in ids - {q})
    pages = run(spark, "f06_coverage", dense)
    assert {r.query_id for r in pages if r.item_id == 180 or r.query_id == 180 and r.item_id == 181} == ids
    late = {r.item_id for r in facts(spark, str(dense)).where("year >= 1995").collect()} & ids
    assert sorted((r.query_id, r.item_id) for r in run(spark, "j09_refilter", dense)) == sorted((q, i) for q in ids for i in late - {q})


@pytest.mark.parametrize(("most", "page"), [(1, None), (2, None), (2, 12), (3, 30)])
def test_author_cap_of_sets_is_greedy(spark, most, page):
    import random

    rng, rows = random.Random(most), []
    for q in range(6):
        rows += [(q, 1000 + i, i, rng.sample("abcdef", rng.randrange(4))) for i in range(1, 81)]
    authored = spark.createDataFrame(rows, "query_id long, item_id long, rank long, authors array<string>")
    want = []
    for q in range(6):
        counts, kept, aside = {}, [], []
        for _, item, rank, authors in [r for r in rows if r[0] == q]:
            full = any(counts.get(a, 0) >= most for a in authors)
            (aside if full else kept).append((rank, item))
            for a in () if full else authors:
                counts[a] = counts.get(a, 0) + 1
        kept = sorted(kept + aside[: max(0, (page or 0) - len(kept))])
        want += [(q, item, k) for k, (_, item) in enumerate(kept, 1)]
    assert sorted(map(tuple, ranking.capped(authored, most, page).collect())) == sorted(want)


def test_liked_has_all_labelled_positives(spark):
    positives = {(r.user_id, r.item_id) for r in run(spark, "e03_l01_interactions", SF) if r.label == 1}
    got = {(r.user_id, r.item_id) for r in run(spark, "d04_h02_liked", SF)}
    known = {r.user_id for r in fixtures.frame(spark, SF, "users").collect()}
    high = {(r.user_id, r.item_id) for r in fixtures.frame(spark, SF, "reviews").where("rating >= 4").collect() if r.user_id in known}
    assert positives - high and got == positives | high


def test_means_are_of_all_vectors(spark):
    import numpy as np

    by = {}
    for r in fixtures.table(spark, SF, "embeddings").collect():
        v = np.array(r.embedding, np.float64)
        by.setdefault(r.label, []).append(v / np.linalg.norm(v))
    want = {k: max(m / np.linalg.norm(m)) for k, m in ((k, np.mean(v, axis=0)) for k, v in by.items())}
    got = {r.query_id: r.largest for r in run(spark, "i04_seed_average", SF)}
    assert got == pytest.approx(want, abs=2e-6)


def test_vibe_keys_and_rankings_are_whole(spark):
    """Singles and pairs of all tags (20 at most) for each of five systems; every key is
    ranked to 500 at most."""
    from collections import Counter

    rows = facts(spark, SF).select("item_systems", "item_tags").collect()
    n_tags = min(20, len({t for r in rows for t in r.item_tags}))
    n_systems = min(5, len({s for r in rows for s in r.item_systems}))
    keys = {r.key for r in run(spark, "h06_vibe_keys", SF)}
    assert len(keys) == n_systems * n_tags * (n_tags + 1) // 2
    depth = Counter(r.query_id for r in run(spark, "j04_vibe_mode", SF))
    assert set(depth) <= keys and 50 < max(depth.values()) <= 500


def test_sweeps_have_the_whole_grid(spark):
    caps = {(r.cap, r.cap_order): tuple(r)[2:] for r in run(spark, "k05_cap_sweep", SF)}
    assert set(caps) == {(c, o) for c in (50, 100, 150, 200, 300, 500, 750, 1000, 1500, None) for o in ("pre", "post")}
    assert caps[None, "pre"] == caps[None, "post"] == caps[1500, "post"]
    pools = {(r.floor, r.policy): r.mean for r in run(spark, "k06_prefilter_sweep", SF)}
    highest = pool(spark, SF).agg({"cos": "max"}).first()[0]
    floors = {f for f in (0.25, 0.3, 0.35, 0.4, 0.45) if f <= highest}
    assert set(pools) == {(f, p) for f in floors for p in filters.POLICIES}


def test_corpus_facets_have_tags(spark):
    from collections import Counter

    want = Counter(t for r in fixtures.frame(spark, SF, "items").collect() for t in {x.strip() for x in r.tags.split(",")} - {""})
    assert {r.value: r.n for r in run(spark, "e19_corpus_facets", SF) if r.facet == "tags"} == want


def test_bootstrap_has_all_resamples(spark, monkeypatch):
    from recoflow.operators import evaluate

    asked = []
    monkeypatch.setattr(evaluate, "bootstrap", lambda deltas, resamples=2000, *a: asked.append(resamples) or deltas.selectExpr("1 n", "0d mean", "0d low", "0d high", "false significant").limit(1))
    run(spark, "k09_k10_bootstrap", SF)
    assert asked == [2000]


def test_offline_run_is_reviewer_mode(spark):
    import math

    import numpy as np

    from recoflow.plans.evaluation import parts

    p = parts(spark, SF).collect()
    bayes = {r.item_id: r.bayesian_avg for r in fixtures.frame(spark, SF, "stats").collect()}
    known = {r.item_id for r in facts(spark, SF).select("item_id").collect()}
    unit = {r.vec_id: np.array(r.embedding, np.float64) / np.linalg.norm(r.embedding) for r in fixtures.table(spark, SF, "embeddings").collect()}
    recall = []
    for u in {r.user_id for r in p if r.split == "test"}:
        mine = [r for r in p if r.user_id == u]
        seeds = [unit[r.item_id] for r in mine if r.split == "train" and r.label == 1 and r.item_id in unit]
        if not seeds:
            continue
        mean = np.mean(seeds, axis=0)
        out = {r.item_id for r in mine if r.split != "test"}
        cos = {i: float(mean @ v / np.linalg.norm(mean)) for i, v in unit.items() if i in known - out}
        rel = {i: round(1 / (1 + math.exp(1 - 4 * c)), 6) for i, c in cos.items() if c >= 0.25}
        order = sorted(rel, key=lambda i: (-round(0.5 * rel[i] + 0.5 * bayes.get(i, 2.5) / 5, 6), i))
        test = {r.item_id for r in mine if r.split == "test"}
        recall += [len(test & set(order[:10])) / len(test)] if order else []
    got = run(spark, "k03_offline_run", SF)[0]
    assert (got.n_queries, got.recall_10) == (len(recall), pytest.approx(sum(recall) / len(recall), abs=2e-6))
