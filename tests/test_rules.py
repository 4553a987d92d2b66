"""Author cap by peeling, names by grams, counted pairs, bootstrap by weights."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import Observation

from recoflow.operators import evaluate, interactions, names, ranking


def greedy(rows, most):
    kept, counts = [], {}
    for q, i, r, authors in sorted(rows, key=lambda x: (x[0], x[2])):
        if all(counts.get((q, a), 0) < most for a in authors):
            kept.append((q, i))
            for a in authors:
                counts[q, a] = counts.get((q, a), 0) + 1
    return sorted(kept)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_cap_equals_the_greedy_rule(spark, most):
    rng = random.Random(most)
    rows = [(q, 100 * q + r, r, rng.sample("abcdefghijkl"[: 3 + q], rng.choice([0, 1, 1, 2, 3]))) for q in range(8) for r in range(1, 41)]
    pool = spark.createDataFrame(rows, "query_id long, item_id long, rank long, authors array<string>")
    assert sorted(map(tuple, ranking.capped(pool, most).select("query_id", "item_id").collect())) == greedy(rows, most)


def test_single_authors_and_rare_ones_need_no_fold(spark):
    rng = random.Random(1)
    single = [(1, r, r, [rng.choice("abc")]) for r in range(1, 60)]
    rare = [(2, r, r, [f"x{r}", f"x{r + 1}"]) for r in range(1, 30)]
    both = spark.createDataFrame(single + rare, "query_id long, item_id long, rank long, authors array<string>")
    assert ranking.peeled(both, 2).where("aside IS NULL").count() == 0
    knotted = spark.createDataFrame([(1, r, r, ["a", "b"] if r % 2 else ["b", "c"]) for r in range(1, 30)], both.schema)
    assert ranking.peeled(knotted, 2).where("aside IS NULL").count() == 4


def test_names(spark):
    labels = [(1, "Alpha Centauri", 3), (2, "Beta", 1), (3, "alphabet", 2), (4, "Ab", 9), (5, "beta", 1), (6, None, 0), (7, "É là", 5)]
    typed = ["ALPHA", "beta", "bet", "a", "ab", "", "xyz", None, "a c", "entaur", "é l", "\u00c9 L\u00c0", "alphabets"]
    got = names.resolved(spark.createDataFrame(list(enumerate(typed)), "request_id long, typed string"), spark.createDataFrame(labels, "key long, label string, place long"))

    def plain(t):
        if t is None:
            return None
        found = [(x.lower() != t.lower(), place, k) for k, x, place in labels if x is not None and t.lower() in x.lower()]
        return min(found)[2] if found else None

    assert sorted(map(tuple, got.collect())) == [(i, plain(t)) for i, t in enumerate(typed)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_skipped_pairs_are_counted(spark):
    parts = spark.createDataFrame([("u", 1, 1), ("u", 2, 0), ("u", 3, 0), ("v", 1, 1), ("w", 1, 1), ("w", 2, 0), ("u", 9, 1)], "user_id string, item_id long, label int")
    profiles = spark.createDataFrame([("u", "pu"), ("v", "pv")], "user_id string, profile_text string")
    docs = spark.createDataFrame([(1, "one"), (2, None), (3, "three")], "item_id long, doc_text string")
    seen = Observation()
    got = interactions.text_triplets(parts, profiles, docs, seen)
    assert [tuple(r) for r in got.collect()] == [("u", 1, 3, "pu", "one", "three")]
    assert seen.get == {"n_kept": 1, "n_skipped": 3}
    seen = Observation()
    pairs = interactions.text_pairs(parts, profiles, docs, seen)
    assert sorted((r.user_id, r.item_id, r.label) for r in pairs.collect()) == [("u", 1, 1), ("u", 3, 0), ("v", 1, 1)]
    assert seen.get == {"n_kept": 3, "n_skipped": 4}


def plain_means(deltas, resamples, seed=7):
    p = evaluate.PRIME
    x = {q: int(hashlib.md5(f"{seed}|{q}".encode()).hexdigest()[:8], 16) % p for q in deltas}
    out = []
    for b in range(1, resamples + 1):
        step, shift = (b * 1103515245 + 12345) % p, (b * 22695477 + 1) % p
        w = {q: sum((x[q] * step + shift) % p / p >= t for t in evaluate.POISSON_STEPS) for q in deltas}
        if sum(w.values()):
            out.append(sum(w[q] * deltas[q] for q in deltas) / sum(w.values()))
    return out


def test_bootstrap_against_loops_and_the_normal_interval(spark):
    rng = np.random.default_rng(3)
    variants = {"a": dict(enumerate(rng.normal(0.3, 1, 300).tolist())), "b": dict(enumerate(rng.normal(0, 2, 200).tolist()))}
    rows = [(v, q, d) for v, ds in variants.items() for q, d in ds.items()]
    df = spark.createDataFrame(rows, "v string, query_id long, delta double").repartition(6)
    got = {r["v"]: r for r in evaluate.bootstrap(df, 2000, 7, "v").collect()}
    for v, ds in variants.items():
        means = plain_means(ds, 2000)
        assert got[v]["n"] == len(ds) and abs(got[v]["mean"] - np.mean(list(ds.values()))) < 1e-9
        assert np.allclose([got[v]["low"], got[v]["high"]], np.percentile(means, [2.5, 97.5]))
        error = np.std(list(ds.values())) / np.sqrt(len(ds))
        assert abs(got[v]["low"] - (got[v]["mean"] - 1.96 * error)) < 0.25 * error
        assert abs(got[v]["high"] - (got[v]["mean"] + 1.96 * error)) < 0.25 * error
    assert got["a"]["significant"]
    one = evaluate.bootstrap(df.where("v = 'b'").select("query_id", "delta"), 200).first()
    assert one["n"] == 200
    plan = evaluate.bootstrap(df, 50, 7, "v")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
