"""Audit of result pages, corpus vocabularies, variants of the prefilter."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from recoflow.operators import evaluate, facets, filters

ITEM = "item_id long, title string, author string, year int, tags string, system string, description string"
ITEMS = [
    (1, "Zork", "Ann", 1980, "Fantasy, Not a Game, REVIEWS", "Z", "text"),
    (2, " Untitled ", None, None, " , ", "n/a", ""),
    (3, "Anthology", "?", 1999, "anthology, Collection, anthology of tests", "TADS", "x"),
    (4, "Clean", "Bob", 2001, "puzzle", "Inform", "x"),
    (5, "Never shown", None, None, "unfinished", "", ""),
]


def audited(spark):
    shown = [("item", "a", 1), ("item", "b", 1), ("author", "c", 1), ("reviewer", "d", 1), ("item", "a", 2), ("item", "a", 2), ("author", "c", 3), ("author", "c", 4), ("item", "b", 9)]
    pages = spark.createDataFrame(shown, "mode string, key string, item_id long")
    return pages, evaluate.audit(pages, spark.createDataFrame(ITEMS, ITEM))


def test_faults_of_shown_items(spark):
    found = defaultdict(list)
    for r in audited(spark)[1].collect():
        found[r.item_id].append((r.issue, r.tag))
    blank = ["empty author", "empty title", "missing year", "no description", "no system", "no tags"]
    assert sorted(found[1]) == [("suspect tag: not-a-game", "Not a Game"), ("suspect tag: review/essay", "REVIEWS")]
    assert sorted(i for i, _ in found[2]) == blank and all(t is None for _, t in found[2])
    # a pattern is met by the whole tag only; two tags of one pattern are two rows
    assert sorted(found[3]) == [("empty author", None), ("suspect tag: collection", "Collection"), ("suspect tag: collection", "anthology")]
    assert 4 not in found and 5 not in found
    assert sorted(i for i, _ in found[9]) == blank


def test_an_item_counts_once_with_three_of_its_pages(spark):
    pages, faults = audited(spark)
    seen = {r.item_id: r.seen_in for r in faults.collect()}
    assert seen[1] == ["author:c", "item:a", "item:b"] and seen[2] == ["item:a"]
    asked = spark.createDataFrame([("item", "a"), ("item", "z"), ("author", "c"), ("author", "y")], "mode string, key string")
    total = {r.issue: (r.n_items, r.n) for r in evaluate.audit_summary(asked, pages, faults).collect()}
    assert total["suspect tag: collection"] == (1, 2) and total["no tags"] == (2, 2)
    assert total["queries: item"] == (0, 2) and total["empty queries: item"] == (0, 1) and total["empty queries: author"] == (0, 1)


def test_audit_of_nothing(spark):
    pages, _ = audited(spark)
    assert evaluate.audit(pages.limit(0), spark.createDataFrame(ITEMS, ITEM)).count() == 0
    assert evaluate.audit(pages, spark.createDataFrame([], ITEM)).where("issue = 'empty title'").count() == 5


def test_vocabularies_merge_casings(spark):
    rows = [(1, "Red, red, RED"), (2, "red"), (3, "Red"), (4, "Blue , green"), (5, None), (6, ""), (7, "GREEN")]
    items = spark.createDataFrame(rows, "item_id long, tags string")
    values, holders = defaultdict(Counter), defaultdict(set)
    for i, text in rows:
        for v in {x.strip() for x in (text or "").split(",")} - {""}:
            values[v.lower()][v] += 1
            holders[v.lower()].add(i)
    want = {(min(c, key=lambda v: (-c[v], v)), len(holders[k])) for k, c in values.items()}
    got = facets.vocabularies(items, ("tags",)).collect()
    assert {(r.label, r.n) for r in got} == want and len(got) == len(want)
    assert facets.vocabularies(items.limit(0), ("tags",)).count() == 0


def test_years_have_no_gaps(spark):
    years = lambda *ys: [r.year for r in facets.year_list(spark.createDataFrame([(y,) for y in ys], "year int")).collect()]
    assert years(1971, None, 1968) == [1971, 1970, 1969, 1968]
    assert years(2000) == [2000] and years(None) == [] and years() == []


def test_variants_keep_what_single_policies_keep(spark):
    rows, names = [], "abcde"
    for q in range(12):
        for i in range(15):
            h = (q * 31 + i * 17) % 97
            rows.append((q, i, round(0.2 + h / 300, 3), [names[(h + k) % 5] for k in range(h % 3)], [f"s{h % 3}"], list(names[: q % 5]), [f"s{q % 3}"]))
    pool = spark.createDataFrame(rows, "query_id long, item_id long, cos double, item_tags array<string>, item_systems array<string>, query_tags array<string>, query_systems array<string>")
    floors = (0.25, 0.45, 0.9)
    variants = filters.prefilter_variants(pool, floors)
    assert variants.count() == len(rows) * len(floors) * len(filters.POLICIES)
    got = {(r.floor, r.policy, r.query_id, r.item_id) for r in variants.where("kept").collect()}
    want = set()
    for f in floors:
        for p in filters.POLICIES:
            want |= {(f, p, r.query_id, r.item_id) for r in filters.prefiltered_by(pool.where(F.col("cos") >= f), p).collect()}
    assert got == want


def test_pages_of_variants(spark):
    rows = [(1, "a", 1, 1), (1, "a", 2, 2), (1, "a", 3, None), (1, "b", 1, None), (1, "b", 2, 1), (1, "c", 1, None), (2, "a", 5, None), (2, "b", 5, 1)]
    ranking = spark.createDataFrame(rows, "query_id long, v string, item_id long, rank long")
    got = {(r.query_id, r.v): (r.n, r.overlap, r.same_first, r.identical) for r in evaluate.variant_pages(ranking, F.col("v") == "a", 25, "v").collect()}
    assert got == {(1, "a"): (2, 1.0, 1, 1), (1, "b"): (1, 0.5, 0, 0), (1, "c"): (0, 0.0, 0, 0), (2, "a"): (0, 1.0, 0, 1), (2, "b"): (1, 1.0, 0, 0)}
