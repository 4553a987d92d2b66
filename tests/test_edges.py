"""Small tables, one rule each, and properties of results."""

import pytest
from pyspark.sql import functions as F

from recoflow.functions import text as T
from recoflow.operators import evaluate, facets, filters, interactions, ranking
from recoflow.operators.documents import rating_stats


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("positives", "want"),
    [(0, {}), (1, {"train": 1}), (2, {"train": 1, "test": 1}), (3, {"train": 1, "val": 1, "test": 1}), (4, {"train": 2, "val": 1, "test": 1}), (25, {"train": 21, "val": 2, "test": 2})],
)
def test_split_sizes(spark, positives, want):
    rows = [("u", i, 1) for i in range(positives)] + [("u", 100, 0)]
    parts = interactions.split(spark.createDataFrame(rows, "user_id string, item_id long, label int"))
    got = {r.split: r["count"] for r in parts.where("label = 1").groupBy("split").count().collect()}
    assert got == want
    assert parts.where("label = 0 AND split <> 'train'").count() == 0


def prefilter(spark, query_tags, items, **options):
    rows = [(1, i, query_tags, tags) for i, tags in enumerate(items)]
    pool = spark.createDataFrame(rows, "query_id long, item_id long, query_tags array<string>, item_tags array<string>")
    return sorted(r.item_id for r in filters.tag_prefilter(pool, **options).collect())


def test_tag_prefilter_relaxes_by_query(spark):
    items = [["a", "b"], ["a"], ["z"]]
    assert prefilter(spark, ["a", "b", "c"], items) == [0]
    assert prefilter(spark, ["a", "q", "c"], items) == [0, 1]
    assert prefilter(spark, ["a", "b"], items) == [0, 1]
    assert prefilter(spark, ["q"], items) == [0, 1, 2]
    assert prefilter(spark, [], items) == [0, 1, 2]


def test_ratings(spark):
    rows = [(1, 0.125), (1, 0.125), (2, float("nan")), (2, None), (3, 5.0)]
    got = {r.item_id: (r.review_count, r.avg_rating, r.bayesian_avg) for r in rating_stats(spark.createDataFrame(rows, "item_id long, rating double")).collect()}
    assert got == {1: (2, 0.12, 2.53), 3: (1, 5.0, 3.75)}


def test_blend_of_unrated(spark):
    assert one(spark, ranking.blend(F.col("r"), F.lit(None).cast("double")), r=0.8) == pytest.approx(0.65)


def test_filters_off_and_unknown(spark):
    df = spark.createDataFrame([(1, None, ","), (2, 1999, "a b, c")], "item_id long, year int, tags string")
    assert df.where(filters.year_between(F.lit(1990), F.lit(2000))).count() == 1
    assert df.where(filters.year_between(F.lit(2000), F.lit(1990))).count() == 2
    assert df.where(filters.terms_match("tags", F.array(F.lit(" ")))).count() == 2
    assert df.where(filters.terms_match("tags", F.array(F.lit("B")))).count() == 1


def test_text_rules(spark):
    assert one(spark, T.titled(F.col("s")), s="o'x spanglish") == "O'X Spanglish"
    assert one(spark, T.description_text("s"), s="<p>a &lt;b&gt;x&lt;/b&gt;</p>y &amp; <3 z") == "a x y & <3 z"
    assert one(spark, T.joined(T.clean_systems("s")), s="  Inform 7 (alternative)/TADS 3.1, inform") == "inform, tads"
    assert one(spark, T.joined(T.filtered_tags("s")), s="Pink, IFComp 2019, Cave, cave, jamboree") == "cave"
    assert one(spark, T.language_names("s"), s="en-US, zh_Hans; qqq/klingon (old), und") == "English, Chinese, QQQ, Klingon"
    assert one(spark, T.rating_cell("a", "n"), a=3.05, n=2) == "3.0 (2)"
    assert one(spark, T.rating_cell("a", "n"), a=3.25, n=1) == "3.2 (1)"
    assert one(spark, T.rating_cell("a", "n"), a=3.0, n=0) == "—"


def authored(spark, rows):
    return spark.createDataFrame([(1, i, i, a) for i, a in enumerate(rows, 1)], "query_id long, item_id long, rank long, authors array<string>")


def test_author_cap(spark):
    pool = authored(spark, [["a"], ["a", "b"], ["a"], ["b"], ["b", "c"], ["d"]])
    assert [r.item_id for r in ranking.capped(pool, 2).orderBy("rank").collect()] == [1, 2, 4, 6]
    assert [r.item_id for r in ranking.capped(pool, 2, page=5).orderBy("rank").collect()] == [1, 2, 3, 4, 6]
    assert [r.item_id for r in ranking.capped(pool, 2, page=50).orderBy("rank").collect()] == [1, 2, 3, 4, 5, 6]
    assert ranking.capped(pool, 2, off=F.lit(True)).count() == 6


def test_coverage_swaps_each_item_once(spark):
    rows = [(1, i, i, v) for i, v in enumerate([["x"], ["x"], ["x"], ["y", "z"], ["z"]], 1)]
    top = spark.createDataFrame(rows, "query_id long, item_id long, rank long, values array<string>")
    targets = spark.createDataFrame([(1, t) for t in "xyzq"], "query_id long, target string")
    assert [r.item_id for r in ranking.covered(top, targets, 3).orderBy("rank").collect()] == [1, 2, 4]


def test_ladder(spark):
    ladder = F.array(*[F.lit(v) for v in (0, 1, 2, 5, 10, 25, 50)])
    assert one(spark, facets.window_of(ladder, F.col("a"), F.col("b")), a=2, b=12) == [2, 5, 10]
    assert one(spark, facets.window_of(ladder, F.col("a"), F.col("b")), a=60, b=70) == [50]
    assert one(spark, facets.clamped(F.lit(1), F.array(F.lit(2), F.lit(5))), a=0) == 2


def test_overlap_of_empty_reference(spark):
    schema = "query_id long, item_id long, rank long"
    some, none = spark.createDataFrame([(1, 1, 1)], schema), spark.createDataFrame([], schema)
    assert ranking.overlap(none, some, 5).first().overlap == 1.0
    assert ranking.overlap(some, none, 5).first().overlap == 0.0


def test_metrics_skip_queries_without_truth(spark):
    ranked = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (2, 7, 1)], "query_id long, item_id long, rank long")
    truth = spark.createDataFrame([(1, 8), (3, 8)], "query_id long, item_id long")
    got = evaluate.query_metrics(ranked, truth, (2,)).collect()
    assert [(r.query_id, r.recall_2, r.rr) for r in got] == [(1, 1.0, 0.5)]


def test_results_do_not_depend_on_partitions(spark):
    rows = [("u%d" % (i % 7), i, i % 2) for i in range(200)]
    pairs = spark.createDataFrame(rows, "user_id string, item_id long, label int")
    results = {tuple(sorted(map(tuple, interactions.split(pairs.repartition(n)).collect()))) for n in (1, 4, 50)}
    assert len(results) == 1


def test_description_patterns(spark):
    assert one(spark, T.description_text("s"), s="a< /p>b</h2 />c<>d") == "a b cd"
    assert one(spark, T.description_text("s"), s="a&nbsp; &nbsp;b\x1cc") == "a b c"


def test_rankings_are_replaced_whole(spark, tmp_path):
    from recoflow.sources import tables as src

    path = f"file://{tmp_path}/ranks"
    for n in (3, 5):
        rows = spark.range(n).selectExpr("'k' AS key", "id AS item_id", "1.0d AS score", "0.5d AS relevance", "id + 1 AS rank")
        src.publish_ranking(rows, path)
        assert src.stored_ranking(spark, path).count() == n
    assert [p.name for p in tmp_path.iterdir()] == ["ranks"]


def test_nearest_of_small_blocks(spark):
    import numpy as np

    from recoflow.operators import vectors

    v = np.random.default_rng(5).normal(size=(60, 4))
    v[10:20] = v[0]
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_id long, vector array<double>")
    got = {(r.query_id, r["rank"]): r.item_id for r in vectors.nearest(items.withColumnRenamed("item_id", "query_id"), items, 4, block=7).collect()}
    for q in range(60):
        want = sorted(range(60), key=lambda i: (-round(float(v[q] @ v[i]), 9), i))[:4]
        assert [got[q, r] for r in range(1, 5)] == want
