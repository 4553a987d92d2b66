"""Facet filters, prefilters by shared tags, exclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recoflow.functions import text as T

#: Multi-valued columns that a term filter reads, and how they are cut.
TERM_FIELDS = {"author": T.AUTHOR_SEPARATORS, "system": T.LIST_SEPARATORS, "genre": T.LIST_SEPARATORS, "language": T.LIST_SEPARATORS, "tags": ","}


def year_between(low: Column, high: Column, year: str = "year") -> Column:
    """Inclusive; an unknown year fails, a missing or turned range filters nothing (C4)."""
    off = low.isNull() | high.isNull() | (low > high)
    return off | F.coalesce(F.col(year).between(low, high), F.lit(False))


def terms_match(field: str, terms: Column, more: str | None = None) -> Column:
    """Any term is part of any value of the field (or of ``more``, C10); no terms filter
    nothing (C5 to C10)."""
    values = T.split_values(field, TERM_FIELDS[field])
    if more is not None:
        values = F.array_union(values, T.split_values(more, TERM_FIELDS[more]))
    some = F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.trim(t) != "")
    return (F.size(some) == 0) | T.contains_any(values, some)


def rated_at_least(least: Column) -> Column:
    """Mean rating, or the smoothed one without it; unrated and NaN fail (C11)."""
    value = F.coalesce("avg_rating", "bayesian_avg")
    rated = F.coalesce(F.col("review_count") != 0, F.lit(True))
    return least.isNull() | F.coalesce(rated & ~F.isnan(value) & (value >= least), F.lit(False))


def counted_at_least(least: Column) -> Column:
    """At least so many ratings."""
    return least.isNull() | F.coalesce(F.col("review_count") >= least, F.lit(False))


FILTER_COLUMNS = "year_low int, year_high int, authors array<string>, systems array<string>, genres array<string>, languages array<string>, tags_any array<string>, topics array<string>, min_rating double, min_count bigint"


def facet_filter(candidates: DataFrame, filters: DataFrame, key: str = "query_id") -> DataFrame:
    """Candidates (with item columns) of each query that pass all its filters.

    filters: the key and FILTER_COLUMNS, null or empty where a field is free.  A query
    without a row there keeps all its candidates.
    """
    named = filters.select(key, *[F.col(c).alias(f"_{c}") for c in filters.columns if c != key])
    f = lambda c: F.col(f"_{c}")
    conditions = [
        year_between(f("year_low"), f("year_high")),
        terms_match("author", f("authors")),
        terms_match("system", f("systems")),
        terms_match("genre", f("genres")),
        terms_match("language", f("languages")),
        terms_match("tags", f("tags_any")),
        terms_match("genre", f("topics"), "tags"),
        rated_at_least(f("min_rating")),
        counted_at_least(f("min_count")),
    ]
    return candidates.join(named, key, "left").where(T.all_of(conditions)).select(candidates.columns)


def filter_spec(choices: DataFrame, spans: DataFrame, key: str = "query_id") -> DataFrame:
    """Effective filters from widget values: a year span as wide as the one on offer, a
    rating or count of 0 are no constraint (C14)."""
    both = choices.join(spans.select(key, F.col("first_year").alias("_a"), F.col("last_year").alias("_b")), key, "left")
    narrow = F.coalesce((F.col("year_low") > F.col("_a")) | (F.col("year_high") < F.col("_b")), F.lit(True))
    some = lambda c: F.when(F.col(c) > 0, F.col(c))
    return both.withColumns({"year_low": F.when(narrow, F.col("year_low")), "year_high": F.when(narrow, F.col("year_high")), "min_rating": some("min_rating"), "min_count": some("min_count")}).drop("_a", "_b")


#: Names that a saved filter may use for a field.
FILTER_SYNONYMS = {"author": "author", "authors": "author", "by": "author", "system": "system", "systems": "system", "genre": "genre", "genres": "genre", "tag": "tags", "tags": "tags", "language": "language", "lang": "language", "year": "year", "years": "year", "rating": "min_rating", "min_rating": "min_rating", "count": "min_count", "min_count": "min_count", "reviews": "min_count"}


def parsed_filters(saved: DataFrame, key: str, spec: str) -> DataFrame:
    """key, field, value for each usable part of ``key:value; key:value`` (B22).  Quotes
    go; unknown fields and numbers that can't be read are left out."""
    part = F.explode(F.split(T.text_of(spec), ";"))
    cut = saved.select(key, part.alias("p")).where(F.contains("p", F.lit(":")))
    names = F.create_map(*[F.lit(x) for pair in FILTER_SYNONYMS.items() for x in pair])
    field = F.try_element_at(names, F.lower(F.trim(F.substring_index("p", ":", 1))))
    value = F.btrim(F.trim(F.expr("substring(p, instr(p, ':') + 1)")), F.lit("\"'"))
    found = cut.select(key, field.alias("field"), value.alias("value")).where(F.col("field").isNotNull() & (F.col("value") != ""))
    number = F.col("field").isin("min_rating", "min_count")
    return found.where(~number | F.col("value").try_cast("double").isNotNull())


def tag_prefilter(pool: DataFrame, min_matches: int = 2, matches_from: int = 3, key: str = "query_id") -> DataFrame:
    """Candidates that share enough tags with their query (C17).

    pool: key, query_tags, item_tags (arrays).  ``min_matches`` tags are asked for where
    a query has ``matches_from`` or more, else one.  A query that would keep nothing
    falls back to one tag, then to its whole pool; a query without tags keeps all.
    """
    shared = F.size(F.array_intersect("query_tags", "item_tags"))
    asked = F.when(F.size("query_tags") >= matches_from, F.lit(min_matches)).otherwise(F.lit(1))
    return _relaxed(pool, [shared >= asked, shared >= 1], key)


def _relaxed(pool: DataFrame, ladder: list[Column], key: str) -> DataFrame:
    """Keep what meets the first condition that anything of the key meets, else all."""
    level = F.lit(len(ladder))
    for k in range(len(ladder) - 1, -1, -1):
        level = F.when(ladder[k], F.lit(k)).otherwise(level)
    best = F.min("_level").over(Window.partitionBy(key))
    return pool.withColumn("_level", level).withColumn("_best", best).where(F.col("_level") <= F.col("_best")).drop("_level", "_best")


POLICIES = ("tags1", "tags1_system", "tags2of3", "tags2of3_system", "tags2")


def _policy_rules() -> tuple[dict[str, Column], Column]:
    """What each policy asks of a candidate, and the first relaxation of all."""
    tags = F.size(F.array_intersect("query_tags", "item_tags"))
    system = F.size(F.array_intersect("query_systems", "item_systems")) >= 1
    most = F.when(F.size("query_tags") >= 3, 2).otherwise(1)
    return {"tags1": tags >= 1, "tags1_system": (tags >= 1) & system, "tags2of3": tags >= most, "tags2of3_system": (tags >= most) & system, "tags2": tags >= 2}, tags >= 1


def prefiltered_by(pool: DataFrame, policy: str, key: str = "query_id") -> DataFrame:
    """The pool under one of the compared policies (C18): one shared tag; and a shared
    system; two tags from three on; and a shared system; two tags always.  Each relaxes
    to one tag and then to the candidate of the highest cosine."""
    rules, one = _policy_rules()
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("cos"), "item_id"))
    return _relaxed(pool.withColumn("_first", first), [rules[policy], one, F.col("_first") == 1], key).drop("_first")


def prefilter_variants(pool: DataFrame, floors: tuple[float, ...], policies: tuple[str, ...] = POLICIES, key: str = "query_id") -> DataFrame:
    """Every row of the pool once a floor and policy, with ``kept``: whether the pool cut at
    that floor keeps it under that policy (K6).  Rows that are not kept stay, so that a
    query which a floor leaves empty still counts.

    The pool is shuffled by its key once: the candidate of the highest cosine is the same at
    every floor that leaves any, and the windows of the variants lie within a key.
    """
    rules, one = _policy_rules()
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("cos"), "item_id")) == 1
    level = lambda p: F.when(rules[p], 0).when(one, 1).when(F.col("_first"), 2).otherwise(3)
    each = F.array(*[F.struct(F.lit(f).alias("floor"), F.lit(p).alias("policy"), level(p).alias("_level")) for f in floors for p in policies])
    out = pool.withColumn("_first", first).withColumn("_v", F.explode(each)).select("*", "_v.*")
    above = F.col("cos") >= F.col("floor")
    best = F.min(F.when(above, F.col("_level"))).over(Window.partitionBy(key, "floor", "policy"))
    return out.withColumn("kept", F.coalesce(above & (F.col("_level") <= best), F.lit(False))).drop("_first", "_v", "_level")


def without_seen(candidates: DataFrame, seen: DataFrame, key: str = "query_id") -> DataFrame:
    """Pairs that are in ``seen`` go."""
    return candidates.join(seen.select(key, "item_id").distinct(), [key, "item_id"], "left_anti")


def in_catalogue(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Candidates that the catalogue still has."""
    return candidates.join(items.select("item_id"), "item_id", "left_semi")


def without_names(df: DataFrame, column: str, names: tuple[str, ...] = T.EXCLUDED_AUTHORS) -> DataFrame:
    """Catch-all names go."""
    return df.where(~F.lower(F.trim(T.text_of(column))).isin(*names))
