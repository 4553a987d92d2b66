"""Corpus operators against brute force on small tables (1, 4, 5, 6, 9, pipeline)."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from recoflow.llm import balltree, chat, linededup, neardup, quality, queries
from recoflow.llm.shingles import shingle_sets

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 5, 7) for r in rows], "doc_id long, text string, label string, n long, row long")


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]


def shingles(text, width):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute_components(rows, width):
    sets = [shingles(t, width) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                label[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    least = {r: min((d for d in g if d is not None), default=None) for r, g in groups.items()}
    return sorted(((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def near_copies(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = [(1000, None), (1001, ""), (1002, " \t "), (1003, "one"), (1004, "ONE"), (1005, "one two"), (None, "null id here"), (None, "null id here"), (7, "same id one"), (7, "same id two")]
    for k in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, 9)):  # some reach 0.8 to the base, some only to others
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        rows.append((k, " ".join(copy)))
    rows += [(500 + k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60)))) for k in range(60)]
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width, monkeypatch):
    monkeypatch.setattr(neardup, "PART", 10)  # common shingles in several parts
    rows = near_copies(width, 150)
    got = neardup.near_duplicates(docs_frame(spark, rows), width, 80).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_components(rows, width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def met(spark, sets, folder):
    rows = [(k, k, len(s), sorted(s)) for k, s in enumerate(sets)]
    frame = spark.createDataFrame(rows, "uid long, label long, n int, hashes array<long>")
    frame.write.parquet(str(folder))
    return {(r.u, r.v) for r in neardup.meeting(neardup.rarest(spark.read.parquet(str(folder)), 80), 80).collect()}


def test_rarest_shingles_miss_no_link(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(neardup, "PART", 16)
    rng = random.Random(6)
    sets = []
    for _ in range(12):
        base = rng.sample(range(900), rng.randint(1, 60))
        for _ in range(rng.randint(1, 25)):
            drop = rng.randint(0, len(base) // 4)
            sets.append(set(rng.sample(base, len(base) - drop)) | set(rng.sample(range(900), rng.randint(0, len(base) // 4))))
    links = {(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets) if (len(y), b) < (len(x), a) and 100 * len(x & y) >= 80 * len(x | y)}
    found = met(spark, sets, tmp_path / "sets")
    assert len(links) > 200 and links <= found
    assert not met(spark, [], tmp_path / "none")


def test_pages_of_one_template_do_not_pair(spark, tmp_path):
    rng = random.Random(7)
    template = " ".join(f"t{k}" for k in range(106))
    counts = []
    for pages in (300, 1200):
        texts = [f"{template} {' '.join(rng.choice('abcdefghijkl') + str(rng.randrange(100)) for _ in range(15))}" for _ in range(pages)]
        sets = [set(h.view(np.int64).tolist()) for h in shingle_sets(texts, 5)]
        assert 0.7 < len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.8
        counts.append(len(met(spark, sets, tmp_path / str(pages))))
    assert counts[0] <= 300 and counts[1] <= 1200


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(docs_frame(spark, [])).count() == 0
    assert neardup.near_duplicates(docs_frame(spark, [(1, None), (2, "")])).where("kept").count() == 2


def test_one_of_each_keeps_columns(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, "quite another text of some words")]
    out = neardup.one_of_each(docs_frame(spark, rows))
    assert out.columns == ["doc_id", "text", "label", "n", "row"]
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4]


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(4)
    for size in (3, 40, 3000):
        pool = rng.integers(0, 2**63, 2 * size, np.uint64)
        errors = []
        for _ in range(30):
            a, b = np.unique(rng.choice(pool, size)), np.unique(rng.choice(pool, size))
            a = np.unique(np.concatenate([a, b[: len(b) * 2 // 3]]))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            found = neardup.estimate(neardup.sketch(a)[None], neardup.sketch(b)[None], np.array([len(a)]), np.array([len(b)]))[0]
            errors.append(found - true)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


def test_shingles_are_sets_of_words():
    texts = ["a b a b a", "", "One", "x y z", "A  b\tA\nb", "q " * 500 + "r"]
    for text, got in zip(texts, shingle_sets(texts, 2), strict=True):
        assert len(got) == len(shingles(text, 2))


LINES = [
    (2, "Shared line of text\nown line number two\nshort\nShared line of text"),
    (1, "  shared LINE of text \nonly here, only once\nshort"),
    (3, "shared line of text\n\n\nown line number two"),
    (4, None),
    (5, ""),
    (6, "repeated inside only\nrepeated inside only"),
    (8, "row one of an id that repeats"),
    (8, "row one of an id that repeats"),
    (None, "only here, only once\nlast of all"),
    (9, "é" * 9 + "\n" + "é" * 10),
    (10, "É" * 10 + "\n" + "é" * 9 + "\n" + "é" * 10),
]


def brute_lines(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    place = lambda d: 2**63 - 1 if d is None else d
    owner = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            owner[key(line)] = min(owner.get(key(line), 2**63), place(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] >= place(d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("batches", "fanout"), [(1, 4), (3, 2), (6, 2)])
def test_line_dedup(spark, batches, fanout):
    out = linededup.drop_lines(docs_frame(spark, LINES), batches=batches, fanout=fanout)
    assert out.columns == ["doc_id", "text", "label", "n", "row", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()), key=repr) == brute_lines(LINES)
    assert linededup.drop_lines(docs_frame(spark, []), batches=batches).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400 + i, [0.5] * 8) for i in range(60)]  # equal vectors
    rows += [(600, None), (650, [float("nan")] * 8), (651, [None] + [1.0] * 7), (652, []), (700, [1.0, 2.0]), (701, [3.0, 1.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame([(*r, 3, 2) for r in rows], "vec_id long, embedding array<float>, rank int, score int")
    got = balltree.top_k(df, F.col("vec_id") % 50 == 0, k=5, shard_rows=100).collect()
    usable = {i: np.floor(256 * np.array(v, np.float64)).astype(int) for i, v in rows if i is not None and v and None not in v and not np.isnan(v).any()}
    want = []
    for q, v in usable.items():
        if q % 50 == 0:
            scores = sorted((-int(v @ c), i) for i, c in usable.items() if i != q and len(c) == len(v))
            want += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:5], 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    assert balltree.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_chats(spark):
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello"),
        (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "bye"),
        (3, 0, "user", "hi"), (3, 1, "assistant", "hello"), (3, 2, "user", "bye"),
        (4, 0, "user", "hi"), (4, 1, "assistant", "hullo"),
        (5, None, None, None), (6, 5, "user", "x"), (6, 5, "user", "x"), (7, 1, "user", "x"), (None, 0, "user", "nobody"),
    ]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, pos int")
    got = {r.conv_id: (r.n_turns, r.n_copies, r.text) for r in chat.format_chats(df).collect()}
    assert set(got) == {2, 4, 5, 6, None}
    assert got[2] == (3, 2, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nbye<|im_end|>\n")
    assert got[5] == (1, 1, "<|im_start|>\n<|im_end|>\n") and got[6][0] == 2
    assert chat.format_chats(df.limit(0)).count() == 0


def test_quality_on_held_out_labels(spark):
    """The labels are never read by the classifier."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.classify(docs).join(labels, "doc_id").toPandas()
    good, bad = scored[scored.quality == 1], scored[scored.quality == 0]
    assert good.keep.mean() > 0.99 and bad.keep.mean() < 0.1
    assert quality.keep_good(docs).count() == quality.classify(docs).where("keep").count()


def test_quality_sample_stays_off_the_driver(spark, monkeypatch):
    docs = docs_frame(spark, [(k, f"Document {k} has words, and number {k * k} is one of them. " * (1 + k % 7)) for k in range(300)])
    facts = quality.voted(docs).cache()
    rows = [(r.votes, r.steps, r.grams) for r in quality._sampled(docs, facts, 300, 250).collect()]
    collected, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: collected.append(out := collect(self)) or out)
    model = quality.train(docs, facts, sample=250, batch=100)
    assert len(rows) == 250 and max(map(len, collected)) < 100
    parts = [rows[k : k + 100] for k in range(0, 250, 100)]
    weights = quality.fit([quality._unpacked(p) for p in parts], [np.array([model.posterior[r[0]] for r in p]) for p in parts])
    assert np.array_equal(model.weights, weights)


def test_quality_edges(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "word " * 100), (3, "x" * 100_000)]
    out = quality.classify(docs_frame(spark, rows))
    assert out.columns == ["doc_id", "weak_label", "score", "keep"] and out.count() == 5
    assert quality.classify(docs_frame(spark, [])).count() == 0
    assert quality.keep_good(docs_frame(spark, rows)).columns == ["doc_id", "text", "label", "n", "row"]


@pytest.mark.parametrize("name", ["op1_top_k_search", "op5_chat_formatting", "op9_line_dedup"])
def test_queries_against_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA), con.sql(queries.ORACLES[name])
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    assert sorted(map(tuple, got.select(order).collect())) == sorted(tuple(dict(zip(want.columns, r, strict=True))[c] for c in order) for r in want.fetchall())


def test_pipeline_by_stages(spark):
    """Each stage against its brute-force version on what the stage before left."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, DATA)
    kept = {r.doc_id: r.text for r in good.collect()}
    assert good.columns == docs.columns and set(kept) == {r.doc_id for r in quality.classify(docs).where("keep").collect()}
    lines = stages["line_dedup"](spark, good, DATA)
    assert lines.columns == docs.columns
    texts = {d: t for d, _, _, t in brute_lines(list(kept.items()))}
    assert {r.doc_id: r.text for r in lines.collect()} == texts
    single = stages["near_dedup"](spark, lines, DATA)
    assert {r.doc_id for r in single.collect()} == {d for d, _, c in brute_components(list(texts.items()), 5) if d == c}
    packed = stages["packing"](spark, single, DATA)
    assert packed.select("doc_id").distinct().count() == single.count()
    digest = lambda df: hashlib.sha256(repr(sorted(map(tuple, df.select("doc_id", "piece", "length", "ids_crc32").collect()))).encode()).hexdigest()
    assert digest(corpus_pipeline.run(spark, DATA)) == digest(packed)


CLASHING = "lost long, _text string, _lines string, _doc long, _row long, n_lines long, n_dropped long, row string, whole string, doc long, owner long, batch long, h1 long"


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_line_dedup_keeps_columns_of_any_name(spark, ansi):
    """Columns named like helpers come through as they are; counts are never negative."""
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        rows = [(d, t, k, "a", "b", k, k, k, k, "c", "d", k, k, k, k) for k, (d, t) in enumerate(LINES)]
        df = spark.createDataFrame(rows, f"doc_id long, text string, {CLASHING}")
        kept = linededup.without_repeated_lines(df)
        assert kept.columns == df.columns
        texts = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
        assert texts == sorted(((d, t) for d, _, _, t in brute_lines(LINES)), key=repr)
        assert sorted(r[2:] for r in kept.collect()) == sorted(r[2:] for r in rows)
        counted = linededup.drop_lines(df).collect()
        assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in counted), key=repr) == brute_lines(LINES)
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_line_dedup_of_a_common_line_and_a_long_text(spark):
    """One line in every document is looked up without a shuffle; a long text is whole."""
    common = "this line stands in every document"
    rows = [(k, f"{common}\nown line of document number {k}") for k in range(3000)]
    rows.append((5000, "\n".join([common, *(f"line {k} of a long text" for k in range(60_000))])))
    out = {r.doc_id: r for r in linededup.drop_lines(docs_frame(spark, rows)).collect()}
    assert out[0].n_dropped == 0 and all(out[k].n_dropped == 1 and out[k].text == rows[k][1].split("\n")[1] for k in range(1, 3000))
    assert out[5000].n_lines == 60_001 and out[5000].n_dropped == 1 and out[5000].text.count("\n") == 59_999


def test_hot_keys_are_split(spark):
    """Half of all rows have one key; the join gives each row once, from many tasks."""
    from recoflow.llm.common import spread_join, written

    rows = written(spark.range(4000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("x")))
    out = spread_join(rows, spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("y")), "k", "x").collect()
    assert sorted((r.k, r.x, r.y) for r in out) == sorted((k, x, 2 * k) for x in range(4000) if (k := 0 if x % 2 == 0 else x) < 3000)


def test_components_that_do_not_settle_are_an_error(spark):
    from recoflow.llm.components import components

    chain = spark.range(40).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.v for r in components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        components(chain, rounds=1)


def test_top_k_of_repeated_ids(spark):
    """Every row is a query and a candidate of its own; the result does not depend on how
    rows are dealt."""
    rng = np.random.default_rng(8)
    rows = [(i // 3 if i % 2 else 50, rng.normal(size=4).astype(np.float32).tolist()) for i in range(90)] + [(50, []), (7, []), (50, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    usable = [(i, np.floor(256 * np.array(v, np.float64)).astype(int)) for i, v in rows if v is not None]
    want = []
    for a, (q, v) in enumerate(usable):
        if q % 50 == 0:
            scores = sorted((-int(v @ c), i) for b, (i, c) in enumerate(usable) if a != b and len(c) == len(v))
            want += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:5], 1)]
    for n in (1, 3, 7):
        got = balltree.top_k(df.repartition(n), F.col("vec_id") % 50 == 0, k=5, shard_rows=20).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_trees_are_opened_best_first():
    """In clustered points a query without a given score opens few of the nodes."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 100
    points = np.floor(np.repeat(centres, 200, 0) + rng.normal(size=(8000, 16)))
    tree = balltree.BallTree(points, np.arange(8000), np.arange(8000))
    queries = points[::400]
    r, ids, scores = tree.search(queries, np.arange(8000)[::400], 5, np.full(20, -np.inf), np.zeros(20, np.int64))
    for q in range(20):
        every = sorted((-int(queries[q] @ p), i) for i, p in enumerate(points) if i != 400 * q)[:5]
        assert sorted(zip((-scores[r == q]).tolist(), ids[r == q].tolist(), strict=True)) == every
    assert tree.read < 20 * len(tree.bounds) / 2


def test_expectation_maximisation_against_plain_loops():
    """Posteriors and vote probabilities of a small table of patterns, by loops."""
    rng = np.random.default_rng(6)
    codes = np.unique(rng.integers(0, 3**quality.LABELLERS, 60))
    counts = rng.integers(1, 50, len(codes)).astype(float)
    posterior, table, prior = quality.estimate_accuracies(codes, counts, rounds=15)
    votes = [[int(c) // 3**k % 3 for k in range(quality.LABELLERS)] for c in codes]
    classes = max(quality.FAULTS.tolist()) + 1
    p = []
    for v in votes:
        first = quality.FAULTS[v.index(1)] if 1 in v else 0
        row = [0.9 if c == first else 0.02 for c in range(classes)]
        p.append([x / sum(row) for x in row])
    for _ in range(15):
        share = [(sum(n * x[c] for n, x in zip(counts, p, strict=True)) + 1) / (sum(counts) + classes) for c in range(classes)]
        good = {}
        for k in range(quality.LABELLERS):
            for c in range(classes):
                weight = [1 + sum(n * x[c] for n, x, v in zip(counts, p, votes, strict=True) if v[k] == vote) for vote in (1, 2)]
                good[k, c] = [1, weight[0] / sum(weight), weight[1] / sum(weight)]
        p = []
        for v in votes:
            row = [share[c] * np.prod([good[k, c][v[k]] for k in range(quality.LABELLERS)]) for c in range(classes)]
            p.append([x / sum(row) for x in row])
    assert np.allclose(posterior, [x[0] for x in p], atol=1e-9) and np.allclose(prior, share, atol=1e-9)
    assert all(np.allclose(table[k, c], good[k, c]) for k in range(quality.LABELLERS) for c in range(classes))


def test_scorer_learns_words():
    """Texts alike in every statistic are told apart by their words; slopes are right."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(("mild", "calm") if k % 2 else ("wild", "harm")) for _ in range(30)) for k in range(400)]
    labels = np.array([k % 2 for k in range(400)], float)
    weights = quality.fit([quality.Described.of(texts[:300])], [labels[:300]], steps=60)
    score = quality.probability(quality.Described.of(texts[300:]).logits(weights))
    assert ((score > 0.5) == (labels[300:] > 0.5)).all()
    some, w = quality.Described.of(texts[:5]), np.random.default_rng(1).normal(size=quality.HASHED + quality.NGRAMS)
    at = [0, int(some.flat[3]), int(some.steps[1].max())]
    slope = some.slopes(np.ones(5))
    for i in at:
        more = w.copy()
        more[i] += 1e-4
        assert np.isclose((some.logits(more).sum() - some.logits(w).sum()) / 1e-4, slope[i], rtol=1e-4)


def test_near_dedup_keeps_columns_of_any_name(spark):
    """Columns named like helpers come through; null and repeated rows, empty tables."""
    rows = [(1, "a b c d e f g", 1, 2, "x"), (2, "a b c d e f g", 3, 4, "y"), (3, None, 5, 6, None), (None, "other words stand here now", 7, 8, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _doc long, _row long, whole string")
    out = neardup.one_of_each(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect()), key=repr) == sorted((rows[0], *rows[2:]), key=repr)
    assert neardup.one_of_each(df.limit(0)).count() == 0
