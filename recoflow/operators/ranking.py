"""Scores, ranks, caps, coverage and pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNRATED = 2.5


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def score_pairs(pairs: DataFrame, make_scorer, keys: tuple[str, ...] = ("query_id", "item_id")) -> DataFrame:
    """Adds relevance = sigmoid of a user's scorer on (query_text, doc_text); a missing
    text is empty (I8).  ``make_scorer()`` runs once a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = make_scorer()
        for pdf in batches:
            raw = np.asarray(score(pdf["query_text"].fillna("").tolist(), pdf["doc_text"].fillna("").tolist()), np.float64)
            yield pdf[list(keys)].assign(relevance=1 / (1 + np.exp(-raw)))

    kinds = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)
    return pairs.select(*keys, "query_text", "doc_text").mapInPandas(run, f"{kinds}, relevance double")


def shared_terms():
    """A scorer for ``score_pairs``: the share of terms that two texts have in common, from -4
    (none) to 4 (all).  Terms are runs of a-z and 0-9 in lower case."""
    import re

    cut = re.compile("[a-z0-9]+")

    def score(queries: list[str], docs: list[str]) -> list[float]:
        sets: dict[str, frozenset[str]] = {}
        terms = lambda t: sets.get(t) or sets.setdefault(t, frozenset(cut.findall(t.lower())))
        out = []
        for q, d in zip(queries, docs, strict=True):
            a, b = terms(q), terms(d)
            shared = len(a & b)
            out.append(8 * shared / max(1, len(a) + len(b) - shared) - 4)
        return out

    return score


def blend(relevance: Column, rating: Column, weight: float | Column = 0.5) -> Column:
    """(1 - w) relevance + w rating / 5; an unrated item counts as 2.5."""
    w = F.lit(weight) if not isinstance(weight, Column) else weight
    return (1 - w) * relevance + w * F.coalesce(rating, F.lit(UNRATED)) / 5


def rescaled(column: str, key: str = "query_id") -> Column:
    """The column between 0 and 1 within each query's pool; one value gives 0."""
    w = Window.partitionBy(key)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return F.when(high > low, (F.col(column) - low) / (high - low)).otherwise(F.lit(0.0))


def ranked(scored: DataFrame, *order: Column | str, key: str = "query_id", most: int | None = None, name: str = "rank") -> DataFrame:
    """Rank from 1 within a key; equals by item_id; the first ``most`` only."""
    by = Window.partitionBy(key).orderBy(*order, "item_id")
    out = scored.withColumn(name, F.row_number().over(by).cast("long"))
    return out if most is None else out.where(F.col(name) <= most)


def by_relevance(scored: DataFrame, key: str = "query_id") -> DataFrame:
    """Display order: relevance, then score."""
    return ranked(scored, F.desc("relevance"), F.desc("score"), key=key)


def peeled(scored: DataFrame, most: int, key: str = "query_id") -> DataFrame:
    """key, item_id, rank, aside, heavy: what the author cap decides without looking at the
    whole pool; aside is null where it must, and heavy then has the authors that matter.

    Authors of at most ``most`` items of a pool can never be full, so they do not matter; an
    item with no other author stays.  An author who shares no item with another one that
    matters gets its first ``most`` items.  Of items with the very same authors only the
    first ``most`` can stay: if one of those was set aside, an author was full, and if none
    was, all are now.
    """
    each = scored.select(key, "rank", F.explode(F.array_distinct("authors")).alias("a"))
    each = each.withColumn("n", F.count("*").over(Window.partitionBy(key, "a"))).where(F.col("n") > most)
    each = each.withColumn("k", F.count("*").over(Window.partitionBy(key, "rank")))
    own = Window.partitionBy(key, "a")
    each = each.withColumn("together", F.max("k").over(own)).withColumn("nth", F.row_number().over(own.orderBy("rank")))
    items = each.groupBy(key, "rank").agg(F.max("together").alias("together"), F.max("nth").alias("nth"), F.array_sort(F.collect_list("a")).alias("heavy"))
    found = scored.select(key, "item_id", "rank").join(items, [key, "rank"], "left")
    same = F.row_number().over(Window.partitionBy(key, "heavy").orderBy("rank"))
    late = F.when(F.col("heavy").isNotNull(), same > most)
    aside = F.when(F.col("heavy").isNull(), F.lit(False)).when(F.col("together") == 1, F.col("nth") > most).when(late, F.lit(True))
    return found.select(key, "item_id", "rank", aside.alias("aside"), "heavy")


def capped(scored: DataFrame, most: int = 2, page: int | None = None, off: Column | None = None, key: str = "query_id") -> DataFrame:
    """At most ``most`` results of any author, greedily by rank.

    scored: key, item_id, rank, authors (array).  An item is set aside if any of its
    authors is already there ``most`` times.  With ``page``, the best of the set-aside
    fill a page that stays short (F4); where ``off`` holds, nothing is set aside (F5).
    New ranks.

    Most items are decided by counts (``peeled``); only those whose authors hang together
    are folded over, a pool at a time.
    """
    marked = scored.select(key, "item_id", "rank", "authors", (F.lit(False) if off is None else F.coalesce(off, F.lit(False))).alias("_off"))
    marked = marked.withColumn("_off", F.max("_off").over(Window.partitionBy(key)))
    decided = peeled(marked.where(~F.col("_off")), most, key)
    entry = F.struct("rank", "item_id", F.col("heavy").alias("authors"))
    pools = decided.where(F.col("aside").isNull()).groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("pool"))
    start = F.struct(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")).alias("n"), F.array().cast("array<bigint>").alias("kept"))

    def step(state: Column, x: Column) -> Column:
        counts = state["n"]
        full = F.exists(x["authors"], lambda a: F.coalesce(F.try_element_at(counts, a), F.lit(0)) >= most)
        held = F.filter(F.map_entries(counts), lambda e: ~F.array_contains(x["authors"], e["key"]))
        more = F.transform(x["authors"], lambda a: F.struct(a.alias("key"), (F.coalesce(F.try_element_at(counts, a), F.lit(0)) + 1).alias("value")))
        taken = F.struct(F.map_from_entries(F.concat(held, more)).alias("n"), F.concat(state["kept"], F.array(x["rank"])).alias("kept"))
        return F.when(full, state).otherwise(taken)

    folded = pools.withColumn("kept", F.aggregate("pool", start, step, lambda s: s["kept"]))
    each = folded.withColumn("x", F.explode("pool")).select(key, "x.item_id", "x.rank", (~F.array_contains("kept", F.col("x.rank"))).alias("aside"))
    each = each.union(decided.where(F.col("aside").isNotNull()).select(key, "item_id", "rank", "aside")).union(marked.where("_off").select(key, "item_id", "rank", F.lit(False)))
    if page is None:
        kept = each.where(~F.col("aside"))
    else:
        place = F.row_number().over(Window.partitionBy(key).orderBy("aside", "rank"))
        free = F.count(F.when(~F.col("aside"), 1)).over(Window.partitionBy(key))
        kept = each.withColumn("_p", place).withColumn("_f", free).where(~F.col("aside") | (F.col("_p") <= F.greatest(F.lit(page), F.col("_f"))))
    return kept.select(key, "item_id", F.row_number().over(Window.partitionBy(key).orderBy("rank")).cast("long").alias("rank"))


def covered(scored: DataFrame, targets: DataFrame, page: int, key: str = "query_id") -> DataFrame:
    """Swap in what the page lacks.

    scored: key, item_id, rank, values (array); targets: key, target.  For each target,
    in alphabetical order, that no item of the first ``page`` has: the best remaining
    item with it takes a place at the end of the page, if none swapped in before
    already has the target.  An item swapped in before has all its targets done, so the
    best item of each target is all that the fold needs.
    """
    top, rest = scored.where(F.col("rank") <= page), scored.where(F.col("rank") > page)
    have = top.select(key, F.explode("values").alias("target")).distinct()
    missing = targets.distinct().join(have, [key, "target"], "left_anti")
    offers = rest.select(key, "item_id", "rank", "values", F.explode("values").alias("target")).join(missing, [key, "target"])
    first = offers.groupBy(key, "target").agg(F.min_by(F.struct("rank", "item_id", "values"), "rank").alias("item"))
    queue = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("target", "item"))).alias("queue"))
    nothing = F.array().cast("array<struct<rank:bigint,item_id:bigint,values:array<string>>>")

    def step(state: Column, x: Column) -> Column:
        done = F.exists(state, lambda s: F.array_contains(s["values"], x["target"]))
        return F.when(done, state).otherwise(F.concat(state, F.array(x["item"])))

    swaps = queue.select(key, F.aggregate("queue", nothing, step).alias("swap"))
    room = top.join(swaps, key, "left").where(F.col("rank") <= page - F.coalesce(F.size("swap"), F.lit(0))).select(key, "item_id", "rank")
    added = swaps.select(key, F.explode("swap").alias("s")).select(key, "s.item_id", "s.rank")
    return ranked(room.union(added).withColumnRenamed("rank", "_old"), "_old", key=key).drop("_old")


def page_of(results: DataFrame, page: int, size: int = 25, key: str = "query_id") -> DataFrame:
    """Page ``page`` (from 1) with the number of results and pages."""
    n = F.count("*").over(Window.partitionBy(key))
    counted = results.withColumn("n_results", n).withColumn("n_pages", F.ceil(F.col("n_results") / size).cast("long"))
    return counted.where(F.col("rank").between((page - 1) * size + 1, page * size))


def displacement(reference: DataFrame, other: DataFrame, k: int, key: str = "query_id") -> DataFrame:
    """Mean change of rank of the reference's first k that ``other`` still has (F8)."""
    both = reference.where(F.col("rank") <= k).select(key, "item_id", F.col("rank").alias("a")).join(other.select(key, "item_id", F.col("rank").alias("b")), [key, "item_id"])
    return both.groupBy(key).agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("displacement"))


def overlap(reference: DataFrame, other: DataFrame, k: int, key: str = "query_id") -> DataFrame:
    """Share of the reference's first k in the other's first k; 1 for an empty reference
    that ``other`` names (H4)."""
    a = reference.where(F.col("rank") <= k).groupBy(key).agg(F.collect_set("item_id").alias("a"))
    b = other.where(F.col("rank") <= k).groupBy(key).agg(F.collect_set("item_id").alias("b"))
    shared = F.size(F.array_intersect("a", "b")) / F.size("a")
    return a.join(b, key, "full").select(key, F.when(F.col("a").isNull(), 1.0).when(F.col("b").isNull(), 0.0).otherwise(shared).alias("overlap"))
