"""Facets of result sets: value counts, year spans, threshold ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recoflow.functions import text as T
from recoflow.operators.filters import TERM_FIELDS

# The thresholds that a page offers, and where a new query starts.
RATING_LADDER = (0.0, 1.0, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5)
COUNT_LADDER = (0, 1, 2, 5, 10, 25, 50)
DEFAULT_RATING, DEFAULT_COUNT = 3.0, 1


def facet_counts(results: DataFrame, facets: tuple[str, ...] = ("genre", "system", "author"), key: str = "query_id") -> DataFrame:
    """key, facet, value, n: items per value within each result set, all facets in one
    pass (E11)."""
    def pairs(facet: str) -> Column:
        values = F.array_distinct(T.split_values(facet, TERM_FIELDS[facet]))
        return F.transform(values, lambda v: F.struct(F.lit(facet).alias("facet"), v.alias("value")))

    each = results.select(key, F.explode(F.concat(*map(pairs, facets))).alias("p")).select(key, "p.*")
    return each.groupBy(key, "facet", "value").agg(F.count("*").alias("n"))


def vocabularies(items: DataFrame, facets: tuple[str, ...] = ("genre", "system", "author", "tags")) -> DataFrame:
    """facet, label, n: the corpus's values in any case alike, in their most frequent casing
    (the least of equals), with the number of their items (E19).

    One pass over the items: a value is counted where it stands, and once an item for its
    key, so only casings are shuffled.  Sort by (n, label) for a menu.
    """
    def casings(facet: str) -> Column:
        values = F.array_distinct(T.split_values(facet, TERM_FIELDS[facet]))
        keys = F.transform(values, lambda v: F.lower(v))
        first = lambda v, i: (F.array_position(keys, F.lower(v)) == i + 1).cast("int")
        return F.transform(values, lambda v, i: F.struct(F.lit(facet).alias("facet"), F.lower(v).alias("key"), v.alias("value"), first(v, i).alias("first")))

    each = items.select(F.explode(F.concat(*map(casings, facets))).alias("c")).select("c.*")
    counted = each.groupBy("facet", "key", "value").agg(F.count("*").alias("n"), F.sum("first").alias("items"))
    label = F.min_by("value", F.struct(-F.col("n"), F.col("value")))
    return counted.groupBy("facet", "key").agg(label.alias("label"), F.sum("items").alias("n")).drop("key")


def year_list(items: DataFrame, year: str = "year") -> DataFrame:
    """year: from the last to the first that occurs, without gaps (E19); none if no item has
    a year."""
    ends = items.agg(F.max(year).alias("b"), F.min(year).alias("a"))
    return ends.select(F.explode(F.expr("CASE WHEN a IS NOT NULL THEN sequence(b, a, IF(b = a, 1, -1)) END")).alias("year"))


def year_span(results: DataFrame, corpus: DataFrame, key: str = "query_id") -> DataFrame:
    """First and last year of a result set; the corpus's where it has none."""
    whole = corpus.agg(F.min("year").alias("_a"), F.max("year").alias("_b"))
    own = results.groupBy(key).agg(F.min("year").alias("a"), F.max("year").alias("b"))
    return own.crossJoin(F.broadcast(whole)).select(key, F.coalesce("a", "_a").alias("first_year"), F.coalesce("b", "_b").alias("last_year"))


def window_of(ladder: Column, low: Column, high: Column) -> Column:
    """Rungs from the highest at or below ``low`` to the highest at or below ``high``; the
    whole ladder if nothing was observed (E13)."""
    floor = F.coalesce(F.array_max(F.filter(ladder, lambda v: v <= low)), ladder[0])
    inside = F.filter(ladder, lambda v: (v >= floor) & (v <= high))
    return F.when(low.isNull(), ladder).when(F.size(inside) == 0, F.array(floor)).otherwise(inside)


def ladders(pool: DataFrame, key: str = "query_id") -> DataFrame:
    """key, ratings, counts: rungs that change anything in a pool (E13).  The rating rung
    0 stays wherever the pool holds an unrated item."""
    n = F.coalesce("review_count", F.lit(0))
    rated = F.when(n > 0, F.col("avg_rating"))
    seen = pool.groupBy(key).agg(F.min(rated).alias("r0"), F.max(rated).alias("r1"), F.min(n).alias("c0"), F.max(n).alias("c1"), F.bool_or(n == 0).alias("unrated"))
    rungs = lambda values, kind: F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")
    ratings = window_of(rungs(RATING_LADDER, "double"), F.col("r0"), F.col("r1"))
    zero = F.lit(RATING_LADDER[0])
    ratings = F.when(F.col("unrated") & ~F.array_contains(ratings, zero), F.concat(F.array(zero), ratings)).otherwise(ratings)
    return seen.select(key, ratings.alias("ratings"), window_of(rungs(COUNT_LADDER, "bigint"), F.col("c0"), F.col("c1")).alias("counts"))


def clamped(value: Column, window: Column) -> Column:
    """The value if it is a rung, else the end on its side."""
    return F.when(F.array_contains(window, value), value).when(value < window[0], window[0]).otherwise(F.element_at(window, -1))


def default_thresholds(pool: DataFrame, key: str = "query_id") -> DataFrame:
    """key, min_rating, min_count of a new query, on the rungs on offer."""
    offered = ladders(pool, key)
    return offered.select(key, clamped(F.lit(DEFAULT_RATING), F.col("ratings")).alias("min_rating"), clamped(F.lit(DEFAULT_COUNT).cast("bigint"), F.col("counts")).alias("min_count"))


def depth_summary(rankings: DataFrame, few: int = 25, key: str = "query_id") -> DataFrame:
    """Keys, rows, median depth and share of short lists of a ranking table."""
    depth = rankings.groupBy(key).agg(F.count("*").alias("n"))
    facts = depth.agg(F.count("*").alias("n_keys"), F.sum("n").alias("n_rows"), F.avg((F.col("n") < few).cast("int")).alias("share_short"))
    middle = quantiles(depth, "n", {"median_depth": 0.5})
    return facts.join(middle, how="left").select("n_keys", "n_rows", "median_depth", "share_short")


def quantiles(df: DataFrame, column: str, shares: dict[str, float], *by: str, ranges: int = 64) -> DataFrame:
    """Exact quantiles of a column, linearly interpolated, one row a group of ``by`` (nulls are
    a group) that has values; nulls and NaN of the column don't count.

    Equal values are counted before they are shuffled.  A sketch cuts each group's distinct
    values into ``ranges``; counts of ranges tell which of them hold the wanted places, and
    only these are sorted, a range at a time.  So no task holds the values of a group.
    """
    group = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(1).alias("_all"))
    value = F.col(column).cast("double")
    counts = df.select(group.alias("_g"), F.nanvl(value, F.lit(None).cast("double")).alias("_v")).where(F.col("_v").isNotNull()).groupBy("_g", "_v").agg(F.count("*").alias("_c"))
    cuts = counts.groupBy("_g").agg(F.percentile_approx("_v", [k / ranges for k in range(1, ranges)], 100 * ranges).alias("_cuts"))
    cut = counts.join(cuts, "_g").withColumn("_r", F.size(F.filter("_cuts", lambda b: b < F.col("_v")))).drop("_cuts")
    whole = Window.partitionBy("_g")
    sizes = cut.groupBy("_g", "_r").agg(F.sum("_c").alias("_n"))
    sizes = sizes.withColumn("_before", F.sum("_n").over(whole.orderBy("_r")) - F.col("_n")).withColumn("_total", F.sum("_n").over(whole))
    place = lambda q: F.lit(float(q)) * (F.col("_total") - 1)
    holds = F.lit(False)
    for q in shares.values():
        for at in (F.floor(place(q)), F.ceil(place(q))):
            holds = holds | ((F.col("_before") <= at) & (at < F.col("_before") + F.col("_n")))
    rows = cut.join(sizes.where(holds), ["_g", "_r"])
    rows = rows.withColumn("_end", F.col("_before") + F.sum("_c").over(Window.partitionBy("_g", "_r").orderBy("_v")))
    value_at = lambda at: F.max(F.when((F.col("_end") - F.col("_c") <= at) & (at < F.col("_end")), F.col("_v")))
    ends = [x for name, q in shares.items() for x in (value_at(F.floor(place(q))).alias(f"_a_{name}"), value_at(F.ceil(place(q))).alias(f"_b_{name}"), F.max(place(q) - F.floor(place(q))).alias(f"_f_{name}"))]
    found = rows.groupBy("_g").agg(*ends)
    between = lambda n: (F.col(f"_a_{n}") + (F.col(f"_b_{n}") - F.col(f"_a_{n}")) * F.col(f"_f_{n}")).alias(n)
    return found.select(*[F.col(f"_g.{c}").alias(c) for c in by], *map(between, shares))


def distribution(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Mean, median, p90, p99 and maximum, linearly interpolated."""
    facts = df.groupBy(*by).agg(F.avg(column).alias("mean"), F.max(column).alias("max"))
    found = quantiles(df, column, {"p50": 0.5, "p90": 0.9, "p99": 0.99}, *by)
    if not by:
        return facts.join(found, how="left").select("mean", "p50", "p90", "p99", "max")
    other = found.withColumnsRenamed({c: f"_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return facts.join(other, same, "left").select(*by, "mean", "p50", "p90", "p99", "max")
