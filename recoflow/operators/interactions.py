"""Labelled interactions, splits, taste profiles, training pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from recoflow.functions import text as T


def real_users(reviews: DataFrame, users: DataFrame) -> DataFrame:
    """Reviews of known users with a plain id."""
    return reviews.join(users.select("user_id"), "user_id", "left_semi").where(F.col("user_id").rlike("^[a-z0-9]+$"))


def labelled(reviews: DataFrame, stats: DataFrame, band: float = 0.25, default: float = 3.5) -> DataFrame:
    """1 above and 0 below the item's smoothed rating by more than ``band``; between them
    a review says nothing (C16, D3).  One row a pair: a positive wins (H1)."""
    known = reviews.join(stats.select("item_id", "bayesian_avg"), "item_id", "left").withColumn("base", F.coalesce("bayesian_avg", F.lit(default)))
    rating = F.nanvl(F.col("rating"), F.lit(None).cast("double"))
    label = F.when(rating > F.col("base") + band, 1).when(rating < F.col("base") - band, 0)
    pairs = known.select("user_id", "item_id", label.alias("label")).where(F.col("label").isNotNull())
    return pairs.groupBy("user_id", "item_id").agg(F.max("label").alias("label"))


def with_minimums(pairs: DataFrame, per_user: int = 2, per_item: int = 2) -> DataFrame:
    """Users with enough pairs; then, counted after that, items with enough."""
    users = pairs.withColumn("_n", F.count("*").over(Window.partitionBy("user_id"))).where(F.col("_n") >= per_user)
    return users.withColumn("_n", F.count("*").over(Window.partitionBy("item_id"))).where(F.col("_n") >= per_item).drop("_n")


def interactions(reviews: DataFrame, users: DataFrame, stats: DataFrame) -> DataFrame:
    """The labelled interactions (L1)."""
    return with_minimums(labelled(real_users(reviews, users), stats))


def split(pairs: DataFrame, val: float = 0.1, test: float = 0.1, seed: int = 42) -> DataFrame:
    """Each user's positives into train, val and test by a hash order (F2, H3).

    One positive trains; two give train and test; three one each; from four on, test and
    val get max(1, round(n f)) (half to even) and train at least one.  Negatives train.
    """
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), "user_id", F.col("item_id").cast("string")))
    good = Window.partitionBy("user_id", "label")
    place, n = F.row_number().over(good.orderBy(key, "item_id")), F.count("*").over(good)
    share = lambda f: F.greatest(F.lit(1), F.rint(n * f)).cast("int")
    n_test = F.when(n < 2, 0).when(n < 4, 1).otherwise(share(test))
    n_val = F.when(n < 3, 0).when(n < 4, 1).otherwise(share(val))
    name = F.when(F.col("label") == 0, "train").when(place <= n_test, "test").when((place <= n_test + n_val) & (place < n), "val").otherwise("train")
    return pairs.withColumn("split", name)


def split_counts(parts: DataFrame) -> DataFrame:
    """Rows, users and items of each split and label."""
    return parts.groupBy("split", "label").agg(F.count("*").alias("n_rows"), F.countDistinct("user_id").alias("n_users"), F.countDistinct("item_id").alias("n_items"))


def liked(positives: DataFrame, reviews: DataFrame, users: DataFrame, least: float = 4.0) -> DataFrame:
    """Positive pairs and high ratings of known users."""
    high = reviews.where(F.col("rating") >= least).join(users.select("user_id"), "user_id", "left_semi").select("user_id", "item_id")
    return positives.select("user_id", "item_id").union(high).distinct()


def seen(reviews: DataFrame, plays: DataFrame) -> DataFrame:
    """What a user has reviewed or played."""
    return reviews.select("user_id", "item_id").union(plays.select("user_id", "item_id")).distinct()


def top_of(each: DataFrame, key: str, n: int) -> DataFrame:
    """key, values: the n most frequent values of a key, in that order."""
    counted = each.groupBy(key, "value").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "value"))
    kept = counted.withColumn("place", place).where(F.col("place") <= n)
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("values"))


def taste_profiles(pairs: DataFrame, items: DataFrame, key: str, systems: int = 3, tags: int = 20, min_items: int = 1) -> DataFrame:
    """key, n_items, profile_text of users over liked items (E7) or of authors over their
    own ones (E8)."""
    facts = pairs.join(items.select("item_id", T.clean_systems("system").alias("s"), T.merged_tags("genre", "tags").alias("t")), "item_id")
    size = facts.groupBy(key).agg(F.countDistinct("item_id").alias("n_items")).where(F.col("n_items") >= min_items)
    top_s = top_of(facts.select(key, F.explode("s").alias("value")), key, systems).withColumnRenamed("values", "s")
    top_t = top_of(facts.select(key, F.explode("t").alias("value")), key, tags).withColumnRenamed("values", "t")
    out = size.join(top_s, key, "left").join(top_t, key, "left")
    empty = F.array().cast("array<string>")
    return out.select(key, "n_items", T.profile_text(F.coalesce("s", empty), F.coalesce("t", empty)).alias("profile_text"))


def canonical(picks: DataFrame, key: str, ranks: DataFrame) -> DataFrame:
    """Picked values (key, value) as one array each, by frequency place, then value;
    values without place last (B16)."""
    placed = picks.distinct().join(ranks.select("value", "place"), "value", "left")
    inorder = F.array_sort(F.collect_list(F.struct(F.coalesce("place", F.lit(1 << 60)).alias("p"), F.col("value").alias("v"))))
    return placed.groupBy(key).agg(F.transform(inorder, lambda x: x["v"]).alias("values"))


def _observed(rows: DataFrame, whole: Column, observation: Observation | None) -> DataFrame:
    """The whole rows; ``observation`` gets n_kept and n_skipped in the same pass, once the
    rows have been computed."""
    marked = rows.withColumn("_whole", whole)
    if observation is not None:
        count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
        marked = marked.observe(observation, count(F.col("_whole")).alias("n_kept"), count(~F.col("_whole")).alias("n_skipped"))
    return marked.where("_whole").drop("_whole")


def text_pairs(pairs: DataFrame, profiles: DataFrame, docs: DataFrame, observation: Observation | None = None) -> DataFrame:
    """Pairs with both texts, and their labels (D6, L2, L4); a pair that lacks a text is left
    out, and counted where there is an ``observation``."""
    both = pairs.join(profiles.select("user_id", "profile_text"), "user_id", "left").join(docs.select("item_id", "doc_text"), "item_id", "left")
    return _observed(both, F.col("profile_text").isNotNull() & F.col("doc_text").isNotNull(), observation)


def triplets(parts: DataFrame) -> DataFrame:
    """Each positive with the user's first negative; users without one are left out (L3)."""
    first = parts.where(F.col("label") == 0).groupBy("user_id").agg(F.min("item_id").alias("negative"))
    return parts.where(F.col("label") == 1).select("user_id", F.col("item_id").alias("positive")).join(first, "user_id")


def text_triplets(parts: DataFrame, profiles: DataFrame, docs: DataFrame, observation: Observation | None = None) -> DataFrame:
    """user_id, positive, negative with profile_text, positive_text, negative_text (L3): each
    positive with the user's first negative that has a text.  Positives without a profile,
    a text or such a negative are left out, and counted where there is an ``observation``."""
    known = docs.where(F.col("doc_text").isNotNull())
    usable = parts.where(F.col("label") == 0).join(known.select("item_id", "doc_text"), "item_id")
    first = usable.groupBy("user_id").agg(F.min(F.struct("item_id", "doc_text")).alias("n")).select("user_id", F.col("n.item_id").alias("negative"), F.col("n.doc_text").alias("negative_text"))
    rows = parts.where(F.col("label") == 1).select("user_id", F.col("item_id").alias("positive"))
    rows = rows.join(profiles.select("user_id", "profile_text"), "user_id", "left").join(first, "user_id", "left")
    rows = rows.join(known.select(F.col("item_id").alias("positive"), F.col("doc_text").alias("positive_text")), "positive", "left")
    whole = F.col("profile_text").isNotNull() & F.col("negative").isNotNull() & F.col("positive_text").isNotNull()
    return _observed(rows, whole, observation).select("user_id", "positive", "negative", "profile_text", "positive_text", "negative_text")


def sampled(pairs: DataFrame, share: float, *key: str) -> DataFrame:
    """A share of the rows by a hash of their key, the same at every run."""
    return pairs.where(hash_unit(*key) < share)


def hash_unit(*key: str) -> Column:
    """A number in [0, 1) from the md5 of the key."""
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0
