"""Item documents: completeness, ratings, normalised fields, vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recoflow.functions import text as T

PRIOR_MEAN, PRIOR_WEIGHT = 3.5, 5


def rating_stats(reviews: DataFrame, item: str = "item_id", prior: float = PRIOR_MEAN, weight: int = PRIOR_WEIGHT) -> DataFrame:
    """Number and mean of known ratings (E1), and the mean drawn to the prior.

    The smoothed value starts from the rounded mean; NaN ratings count as unknown.
    """
    rating = F.nanvl(F.col("rating"), F.lit(None).cast("double"))
    stats = reviews.groupBy(item).agg(F.count(rating).alias("review_count"), T.rounded(F.avg(rating)).alias("avg_rating")).where(F.col("review_count") > 0)
    n = F.col("review_count")
    return stats.withColumn("bayesian_avg", T.rounded((F.lit(weight * prior) + n * F.col("avg_rating")) / (weight + n)))


def with_stats(items: DataFrame, stats: DataFrame, item: str = "item_id", prior: float = PRIOR_MEAN) -> DataFrame:
    """Items with their review stats; without reviews the prior and a count of 0."""
    out = items.join(stats, item, "left")
    fill = {"review_count": F.coalesce("review_count", F.lit(0).cast("long"))}
    return out.withColumns(fill | {c: F.coalesce(c, F.lit(prior)) for c in ("avg_rating", "bayesian_avg")})


def complete(items: DataFrame, columns: tuple[str, ...] = ("title", "author", "system", "description", "tags")) -> DataFrame:
    """Items with something in every required column."""
    return items.where(T.all_of([F.trim(T.text_of(c)) != "" for c in columns]))


def tagged(column: str, tag: str) -> Column:
    return F.array_contains(T.tokens(column), tag)


def split_tagged(items: DataFrame, tag: str = "not a game", item: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """(items kept, ids suppressed): a whole tag, in the original or clean column."""
    both = [c for c in ("tags", "tags_clean") if c in items.columns]
    hit = ~T.all_of([~tagged(c, tag) for c in both])
    return items.where(~hit), items.where(hit).select(item)


def clean_fields(items: DataFrame) -> DataFrame:
    """Adds author_clean, system_clean, tags_clean, year."""
    return items.withColumns(
        {
            "author_clean": T.joined(T.clean_authors("author")),
            "system_clean": T.joined(T.clean_systems("system")),
            "tags_clean": T.joined(T.merged_tags("genre", "tags")),
            "year": T.year_of("published"),
        }
    )


def item_documents(items: DataFrame, reviews: DataFrame, min_reviews: int = 0, item: str = "item_id") -> DataFrame:
    """The documents of complete items with at least ``min_reviews`` ratings (C1, C2, D1,
    B17, B18)."""
    docs = with_stats(complete(items), rating_stats(reviews, item), item)
    docs = clean_fields(docs.where(F.col("review_count") >= min_reviews))
    authors, systems, tags = T.clean_authors("author"), T.clean_systems("system"), T.merged_tags("genre", "tags")
    return docs.withColumns({"doc_text": T.document_text("title", authors, systems, tags, "description"), "query_text": T.profile_text(systems, tags)})


def clean_or_original(df: DataFrame, column: str) -> Column:
    """The clean variant of a column where there is one, else the original."""
    clean = f"{column}_clean"
    return F.coalesce(*[F.col(c) for c in (clean, column) if c in df.columns], F.lit(""))


def casings(items: DataFrame, values: Column, item: str = "item_id") -> DataFrame:
    """key (lower case), label (its most frequent casing, the least of equals), n_items
    (E4)."""
    each = items.select(item, F.explode(values).alias("value")).withColumn("key", F.lower("value"))
    counted = each.groupBy("key", "value").agg(F.count("*").alias("n"))
    label = counted.groupBy("key").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("label"))
    return label.join(each.groupBy("key").agg(F.countDistinct(item).alias("n_items")), "key")


def value_counts(items: DataFrame, values: Column) -> DataFrame:
    """Items per value; a value counts once an item (E5)."""
    return items.select(F.explode(F.array_distinct(values)).alias("value")).groupBy("value").agg(F.count("*").alias("n_items"))


def top_values(items: DataFrame, values: Column, n: int) -> DataFrame:
    """The n most frequent values with their place; equals by value."""
    order = Window.orderBy(F.desc("n_items"), "value")
    best = value_counts(items, values).orderBy(F.desc("n_items"), "value").limit(n)
    return best.withColumn("place", F.row_number().over(order).cast("long"))


def displayed(items: DataFrame, column: str, item: str = "item_id") -> DataFrame:
    """item, display: values in their dominant casing, the most frequent first."""
    values = T.split_values(column, ",")
    labels = casings(items, values, item)
    each = items.select(item, F.explode(T.tokens(column)).alias("key")).join(labels, "key")
    inorder = F.array_sort(F.collect_list(F.struct((-F.col("n_items")).alias("n"), F.col("label").alias("label"))))
    shown = each.groupBy(item).agg(F.array_join(F.transform(inorder, lambda x: x["label"]), ", ").alias("display"))
    return items.select(item).join(shown, item, "left").withColumn("display", T.text_of("display"))


def by_author(items: DataFrame, item: str = "item_id") -> DataFrame:
    """Each author's items."""
    return items.select(F.explode(T.clean_authors("author")).alias("author_id"), item).distinct()


def topics(items: DataFrame, item: str = "item_id") -> DataFrame:
    """Genres and tags as one vocabulary, in any case alike; the casing of tags wins
    (E15)."""
    tags = casings(items, T.split_values("tags", ","), item).withColumn("source", F.lit(0))
    kinds = casings(items, T.split_values("genre"), item).withColumn("source", F.lit(1))
    label = tags.unionByName(kinds).groupBy("key").agg(F.min_by("label", "source").alias("label"))
    each = items.select(item, F.explode(F.array_union(T.tokens("tags"), T.tokens("genre", T.LIST_SEPARATORS))).alias("key"))
    return label.join(each.groupBy("key").agg(F.countDistinct(item).alias("n_items")), "key")


def coverage(items: DataFrame, values: Column, n: int) -> DataFrame:
    """Share of all assignments that the n most frequent values hold."""
    counts = value_counts(items, values)
    top = counts.orderBy(F.desc("n_items"), "value").limit(n).agg(F.sum("n_items").alias("top"))
    return top.crossJoin(counts.agg(F.sum("n_items").alias("every"))).select((F.col("top") / F.col("every")).alias("share"))
