"""What leaves a task: no copies of queries a block, no pairs, no samples on the driver."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from recoflow.operators import learned, vectors
from recoflow.operators.blocks import CellIndex

SF = "/root/testdata/sf0.001"


def frame(spark, points, name="item_id", kind="double"):
    return spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], f"{name} long, vector array<{kind}>")


def points(seed, n, dims=8):
    x = np.random.default_rng(seed).normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def shuffled(df):
    """Records written to shuffles by a run of the plan."""
    df.write.format("noop").mode("overwrite").save()
    nodes, total = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            nodes.append(node.plan())
        else:
            found = node.metrics().get("shuffleRecordsWritten")
            total += found.get().value() if found.isDefined() else 0
            children = node.children()
            nodes += [children.apply(i) for i in range(children.size())]
    return total


def test_a_query_is_sent_once_however_many_cells_reach_it(spark):
    """it was sent once a block, and every model's copy of it on its own."""
    items, asked = frame(spark, points(1, 1500)), frame(spark, points(2, 200), "query_id")
    index = CellIndex(items)
    assert len(index.centres) > 20 and index.bins == 1
    assert index.search(asked, most=3).count() == 200 * 3
    found = vectors.above(asked, items, -0.9, most=3)
    assert shuffled(found) < 400
    truth, seen = (frame(spark, points(2, 200), "query_id").select("query_id", (F.col("query_id") + n).alias("item_id")) for n in (0, 1))
    models = {str(i): np.eye(8) + i for i in range(5)}
    assert shuffled(learned.similarity_validation(asked, items, truth, seen, models)) < 200 * 5 + 500


@pytest.mark.parametrize("held", [8 * 8 * 40, 1 << 20])
def test_bins_and_local_files_find_the_same_pairs(spark, held):
    a, b = points(3, 60), points(4, 500)
    index = CellIndex(frame(spark, b), held=held)
    assert (index.bins > 5) == (held < 1 << 20)
    want = set(zip(*(x.tolist() for x in np.nonzero(a @ b.T >= 0.5)), strict=True))
    got = index.search(frame(spark, a, "query_id"), 0.5)
    assert {(r.query_id, r.item_id) for r in got.collect()} == want

    def make(items):
        return lambda query, at, cos: {"n": [len(at)], "first": [int(items.ids[at].min())]}

    pools = index.fold(frame(spark, a, "query_id"), 0.5, make, "n long, first long").collect()
    assert {(r.query_id, r.n, r["first"]) for r in pools} == {(q, sum(x == q for x, _ in want), min(i for x, i in want if x == q)) for q, _ in want}


def test_cosines_that_are_equal_when_rounded_go_by_id(spark, tmp_path):
    """ranks were by the digits that the result does not show."""
    x = np.zeros((101, 64), np.float32)
    x[:, 1] = 1
    x[0] = np.eye(64, dtype=np.float32)[0]
    for i in range(1, 30):
        x[i, 0] = 0.5 + 1e-8 * i * (8 if i % 2 else 1)  # larger ids are a little nearer
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(driver.oracle_sql()["g01_nearest"]).fetchall()
    got = driver.queries()["g01_nearest"](spark, str(tmp_path)).select("query_id", "item_id", "cos", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("held", [8 * 8 * 30, 1 << 20])
def test_mode_rankings_by_loops_with_one_bin_or_more(spark, held, monkeypatch):
    """F3, F9, F20 and others: pairs were shuffled by item and by key, and the sample of the cell index
    was collected."""
    from pyspark.sql.classic.dataframe import DataFrame as Frame

    from recoflow.plans import pipelines

    a, b = points(5, 40), points(6, 200)
    tags = lambda i, m: [f"t{i % m}", f"t{(i * 3) % m}"]
    own = {q: [] if q % 4 == 0 else [f"t{90 + q}"] if q % 4 == 1 else tags(q, 7) for q in range(40)}
    rating = {i: 1 + (i * 7 % 40) / 10 for i in range(0, 200, 2)}
    queries = spark.createDataFrame([(str(q), v.tolist(), own[q]) for q, v in enumerate(a)], "query_id string, vector array<double>, query_tags array<string>")
    items = spark.createDataFrame([(i, v.tolist(), tags(i, 50)) for i, v in enumerate(b)], "item_id long, vector array<double>, item_tags array<string>")
    stats = spark.createDataFrame(list(rating.items()), "item_id long, bayesian_avg double")
    seen = spark.createDataFrame([(str(q), i) for q in range(40) for i in range(q, 200, 9)], "query_id string, item_id long")
    monkeypatch.setattr(pipelines.CellIndex.__init__, "__defaults__", (None, 2048, 20_000, held))
    sizes, collect = [], Frame.collect
    monkeypatch.setattr(Frame, "collect", lambda self: sizes.append(len(rows := collect(self))) or rows)
    found = pipelines.mode_ranking(queries, items, seen, stats, lambda cos: np.round(cos, 3), floor=0.2, least=0.25, most=12)
    assert max(sizes) <= 6  # cells, not the 200 items of the sample
    want = set()
    for q in range(40):
        pool = [(i, round(float(c), 3)) for i in range(200) if (c := a[q] @ b[i]) >= 0.2 and (i - q) % 9 or i < q and c >= 0.2]
        pool = [(i, c) for i, c in pool if not (i >= q and (i - q) % 9 == 0)]
        near = [(i, c) for i, c in pool if set(own[q]) & set(tags(i, 50))]
        scored = sorted((-round(0.5 * c + 0.5 * rating.get(i, 2.5) / 5, 7), i) for i, c in near or pool if c >= 0.25)
        want |= {(str(q), i, r) for r, (_, i) in enumerate(scored[:12], 1)}
    assert len(want) > 150 and {(r.query_id, r.item_id, r["rank"]) for r in found.collect()} == want
    assert found.columns == ["query_id", "item_id", "score", "relevance", "rank"]


FOLDED = "c13_facet_filter c18_prefilter_policies e11_facet_counts f03_author_cap f03_author_cap_many f04_cap_backfill f05_cap_off f06_coverage f08_displacement g05_cap_before i11_trained_scorer j01_item_mode j07_selection k05_cap_sweep k06_policy_quality k06_prefilter_sweep k07_agreement k08_filtered_consistency k11_sweep_report k17_weight_sweep k18_tag_orders".split()


@pytest.mark.parametrize("name", FOLDED)
def test_no_pair_is_shuffled(spark, name):
    """Pools went through shuffles, some of them several times."""
    assert shuffled(driver.queries()[name](spark, SF)) < 4000  # there are 5,636 pairs


def test_caps_and_coverage_by_loops():
    import pyarrow as pa

    from recoflow.operators import pools
    from recoflow.operators.blocks import Terms

    rng = np.random.default_rng(8)
    for round_ in range(60):
        n, most = int(rng.integers(1, 40)), 1 + round_ % 3
        lists = [[f"a{x}" for x in rng.integers(0, 3 + round_ % 9, rng.integers(0, 4))] for _ in range(n)]
        terms, order = Terms(pa.array(lists, pa.list_(pa.string()))), rng.permutation(n)
        page = None if round_ % 2 else 6
        count, want = {}, np.zeros(n, bool)
        for p, i in enumerate(order):
            own = set(lists[i])
            if all(count.get(a, 0) < most for a in own):
                want[p] = True
                for a in own:
                    count[a] = count.get(a, 0) + 1
        if page is not None:
            for p in np.flatnonzero(~want)[: max(0, page - int(want.sum()))]:
                want[p] = True
        assert np.array_equal(pools.capped(order, terms, most, page), want)
        assert pools.capped(order, terms, most, off=True).all()
        targets = sorted(range(len(terms.texts)), key=terms.texts.__getitem__)
        have, swaps = {a for i in order[:5] for a in lists[i]}, []
        for t in targets:
            text = terms.texts[t]
            offers = [p for p in range(5, n) if text in lists[order[p]]]
            if text not in have and offers and not any(text in lists[order[p]] for p in swaps):
                swaps.append(offers[0])
        assert pools.covered(order, terms, targets, 5).tolist() == [p for p in range(n) if p < 5 - len(swaps)] + sorted(swaps)


def test_filters_within_a_task_are_those_of_tables(spark):
    from recoflow.functions import text as T
    from recoflow.operators import filters, pools

    rng = np.random.default_rng(9)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    rows = [(i, pick(None, 1980, 1999, 2010), pick(None, "", "Ann and Bob", "bob"), pick("Z-code, TADS", "tads 3"), pick(None, "Puzzle/Horror", "horror"), pick("en", "fr, en"), pick("x, Puzzle", "y", None), pick(None, 2.0, 4.0, float("nan")), pick(None, 3.0), pick(None, 0, 3, 9)) for i in range(200)]
    items = spark.createDataFrame(rows, "item_id long, year int, author string, system string, genre string, language string, tags string, avg_rating double, bayesian_avg double, review_count long")
    fields = {"author": "author", "system": "system", "genre": "genre", "language": "language", "tags": "tags"}
    lists = items.select("item_id", "year", "avg_rating", "bayesian_avg", "review_count", *[T.split_values(f, filters.TERM_FIELDS[f]).alias(f"{f}_values") for f in fields])
    import pyarrow as pa

    from recoflow.operators.blocks import Held

    passing = pools.FacetFilter(Held(pa.Table.from_batches(lists.toArrow().to_batches()).sort_by("item_id").combine_chunks()))
    specs = [{"year_low": 1990, "year_high": 2005}, {"year_low": 2005, "year_high": 1990}, {"authors": ["BOB", " "]}, {"topics": ["puzz"], "min_count": 1}, {"min_rating": 3.0}, {"systems": ["tads"], "genres": [], "languages": ["FR"]}, {"tags_any": ["x"]}]
    schema = "query_id long, " + filters.FILTER_COLUMNS
    names = [c.split()[0] for c in filters.FILTER_COLUMNS.split(", ")]
    table = spark.createDataFrame([(q, *(s.get(c) for c in names)) for q, s in enumerate(specs)], schema)
    want = filters.facet_filter(items.crossJoin(table.select("query_id")), table).select("query_id", "item_id").collect()
    for q, spec in enumerate(specs):
        assert np.flatnonzero(passing(spec)).tolist() == sorted(r.item_id for r in want if r.query_id == q), spec
