"""Evaluation of rankings: metrics, sweeps, agreement, paired bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recoflow.functions import text as T


def judged(ranking: DataFrame, labels: DataFrame, key: str = "query_id") -> DataFrame:
    """Adds hit: 1 where the item is another of the query's label, else null.

    labels: item_id, label.  With ``label_counts`` this stands for the pairs of equal
    label, whose number grows with the square of a label's items.
    """
    own, found = labels.select(F.col("item_id").alias(key), F.col("label").alias("_a")), labels.select("item_id", F.col("label").alias("_b"))
    same = (F.col("_a") == F.col("_b")) & (F.col(key) != F.col("item_id"))
    return ranking.join(own, key, "left").join(found, "item_id", "left").withColumn("hit", F.when(same, 1)).drop("_a", "_b")


def label_counts(labels: DataFrame, key: str = "query_id") -> DataFrame:
    """key, n_rel: the number of other items of its label."""
    sizes = labels.groupBy("label").agg((F.count("*") - 1).alias("n_rel")).where(F.col("n_rel") > 0)
    return labels.join(sizes, "label").select(F.col("item_id").alias(key), "n_rel")


def query_metrics(ranking: DataFrame, truth: DataFrame | None, ks: tuple[int, ...] = (5, 10, 20), mrr_at: int | None = None, key: str = "query_id", relevant: DataFrame | None = None) -> DataFrame:
    """key, recall_k, ndcg_k, rr of each query.

    ranking: key, item_id, rank; truth: key, item_id.  Queries without predictions or
    without truth are left out.  The ideal gain counts min(size of truth, k) items; rr
    looks at the first ``mrr_at`` ranks (the largest k).  With ``relevant`` (key, n_rel)
    the ranking has ``hit`` already and no truth is read.
    """
    mrr_at = mrr_at or max(ks)
    hits = ranking if relevant is not None else ranking.join(truth.distinct().withColumn("hit", F.lit(1)), [key, "item_id"], "left")
    relevant = truth.distinct().groupBy(key).agg(F.count("*").alias("n_rel")) if relevant is None else relevant
    gain = F.col("hit") / F.log2(F.col("rank") + 1)
    per = []
    for k in ks:
        inside = F.col("rank") <= k
        per += [F.coalesce(F.sum(F.when(inside, F.col("hit"))), F.lit(0)).alias(f"h_{k}"), F.coalesce(F.sum(F.when(inside, gain)), F.lit(0.0)).alias(f"g_{k}")]
    first = F.min(F.when((F.col("hit") == 1) & (F.col("rank") <= mrr_at), F.col("rank"))).alias("first")
    found = hits.groupBy(key).agg(*per, first).join(relevant, key)
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    out = [key]
    for k in ks:
        out += [(F.col(f"h_{k}") / F.col("n_rel")).alias(f"recall_{k}"), (F.col(f"g_{k}") / ideal(k)).alias(f"ndcg_{k}")]
    return found.select(*out, F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"))


def mean_metrics(metrics: DataFrame, *by: str, key: str = "query_id") -> DataFrame:
    """Macro means over queries, with their number (K1)."""
    names = [c for c in metrics.columns if c not in (key, *by)]
    return metrics.groupBy(*by).agg(F.count("*").alias("n_queries"), *[F.avg(c).alias(c) for c in names])


def sweep(scored: DataFrame, truth: DataFrame | None, caps: tuple[int, ...], k: int = 10, key: str = "query_id", order: str = "score", relevant: DataFrame | None = None) -> DataFrame:
    """Mean metrics for pool caps, each from the one scored table (K5): cap c ranks the
    first c by cosine.  scored: key, item_id, cos, score."""
    position = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("cos"), "item_id"))
    variants = scored.withColumn("pos", position).withColumn("cap", F.explode(F.array(*[F.lit(c) for c in caps]))).where(F.col("pos") <= F.col("cap"))
    again = F.row_number().over(Window.partitionBy(key, "cap").orderBy(F.desc(order), "item_id")).cast("long")
    return metrics_by(variants.withColumn("rank", again), truth, "cap", k, key, relevant)


def metrics_by(ranking: DataFrame, truth: DataFrame | None, variant: str, k: int = 10, key: str = "query_id", relevant: DataFrame | None = None) -> DataFrame:
    """Mean metrics per variant column of a ranking."""
    both = F.struct(key, variant).alias("_q")
    names = ranking.select(variant).distinct()
    if relevant is None:
        per = query_metrics(ranking.select(both, "item_id", "rank"), truth.crossJoin(F.broadcast(names)).select(both, "item_id"), (k,), key="_q")
    else:
        per = query_metrics(ranking.select(both, "item_id", "rank", "hit"), None, (k,), key="_q", relevant=relevant.crossJoin(F.broadcast(names)).select(both, "n_rel"))
    return mean_metrics(per.select(F.col(f"_q.{variant}").alias(variant), *per.columns), variant, key="_q")


def agreement(reference: DataFrame, other: DataFrame, k: int, key: str = "query_id") -> DataFrame:
    """Overlap of the first k, same first item, identical pages, displacement (K7), per
    query of the reference."""
    page = lambda r, name: r.where(F.col("rank") <= k).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"]).alias(name))
    from recoflow.operators.ranking import displacement

    both = page(reference, "a").join(page(other, "b"), key, "left").withColumn("b", F.coalesce("b", F.array().cast("array<bigint>")))
    moved = displacement(reference, other, k, key)
    flags = both.select(key, (F.size(F.array_intersect("a", "b")) / F.size("a")).alias("overlap"), F.coalesce((F.get("a", F.lit(0)) == F.get("b", F.lit(0))).cast("int"), F.lit(0)).alias("same_first"), (F.col("a") == F.col("b")).cast("int").alias("identical"))
    return flags.join(moved, key, "left")


def variant_pages(ranking: DataFrame, base: Column, size: int, *by: str, key: str = "query_id") -> DataFrame:
    """key, by, n, overlap, same_first, identical: a variant's page of each query against the
    query's page under ``base`` (K6).  ``rank`` is null in rows that a variant does not keep;
    an empty base page counts as overlapped whole."""
    inside = F.collect_list(F.when(F.col("rank") <= size, F.struct("rank", "item_id")))
    page = F.transform(F.array_sort(inside), lambda x: x["item_id"])
    per = ranking.groupBy(key, *by).agg(F.count("rank").alias("n"), page.alias("page"))
    per = per.withColumn("base", F.max(F.when(base, F.col("page"))).over(Window.partitionBy(key)))
    overlap = F.when(F.size("base") == 0, 1.0).otherwise(F.size(F.array_intersect("page", "base")) / F.size("base"))
    same = F.coalesce(F.get("page", F.lit(0)) == F.get("base", F.lit(0)), F.lit(False)).cast("int")
    return per.select(key, *by, "n", overlap.alias("overlap"), same.alias("same_first"), (F.col("page") == F.col("base")).cast("int").alias("identical"))


#: The prime of the hash that makes weights, and the steps at which a number
#: in [0, 1) is one more under a Poisson law of mean 1.
PRIME = 2147483647
POISSON_STEPS = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940581, 0.99991676, 0.99998975, 0.99999888)


def resample_weight(unit: Column, b: Column) -> Column:
    """How often resample b draws a row: Poisson of mean 1, from the row's number in [0, PRIME)
    by a linear hash of b, so that rows are independent and results repeat."""
    step, shift = (b * 1103515245 + 12345) % PRIME, (b * 22695477 + 1) % PRIME
    u = (unit * step + shift) % PRIME / PRIME
    return sum((u >= t).cast("int") for t in POISSON_STEPS)


def bootstrap(deltas: DataFrame, resamples: int = 2000, seed: int = 7, *by: str) -> DataFrame:
    """Mean delta and its 2.5 and 97.5 percentiles over resampled queries (K9).

    deltas: query_id, delta (and ``by``); one row a query and ``by``.  Every resample gives
    each query a Poisson weight by a hash of seed, query and resample, the same for all
    variants, so that they are paired; weights and weighted deltas are added up where the
    rows are, and a row a partition, resample and variant is shuffled.  Nothing is drawn,
    numbered or joined.
    """
    unit = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("query_id").cast("string"))), 1, 8), 16, 10).cast("long") % PRIME
    rows = deltas.select(*by, F.col("delta").cast("double").alias("delta"), unit.alias("_u"))
    each = rows.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples).cast("long"))))
    # resample 0 is the sample itself
    w = F.when(F.col("b") == 0, 1).otherwise(resample_weight(F.col("_u"), F.col("b")))
    sums = each.select(*by, "b", "delta", w.alias("w")).groupBy(*by, "b").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("delta")).alias("wd"))
    means = sums.where("w > 0").select(*by, "b", "w", (F.col("wd") / F.col("w")).alias("m"))
    sample = F.when(F.col("b") == 0, F.col("m"))
    drawn = F.when(F.col("b") > 0, F.col("m"))
    out = means.groupBy(*by).agg(F.max(F.when(F.col("b") == 0, F.col("w"))).alias("n"), F.max(sample).alias("mean"), F.percentile(drawn, F.lit(0.025)).alias("low"), F.percentile(drawn, F.lit(0.975)).alias("high"))
    return out.withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0))


def score_change(a: DataFrame, b: DataFrame, key: str = "query_id") -> DataFrame:
    """Mean, p99 and maximum change of the scores of the same pairs."""
    both = a.select(key, "item_id", F.col("score").alias("a")).join(b.select(key, "item_id", F.col("score").alias("b")), [key, "item_id"])
    gap = F.abs(F.col("a") - F.col("b"))
    return both.agg(F.count("*").alias("n_pairs"), F.avg(gap).alias("mean"), F.percentile(gap, F.lit(0.99)).alias("p99"), F.max(gap).alias("max"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, with the side (A7, K12); none if equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def lift(scored: DataFrame, truth: DataFrame | None, bands: int = 10, key: str = "query_id") -> DataFrame:
    """Hit rate and lift over the base rate per band of relevance (K13); without truth,
    scored has ``hit`` already."""
    hit = scored if truth is None else scored.join(truth.distinct().withColumn("hit", F.lit(1)), [key, "item_id"], "left")
    hit = hit.withColumn("hit", F.coalesce("hit", F.lit(0)))
    banded = hit.withColumn("band", F.least(F.floor(F.col("relevance") * bands), F.lit(bands - 1)).cast("long"))
    base = banded.agg(F.avg("hit").alias("base"))
    per = banded.groupBy("band").agg(F.count("*").alias("n_pairs"), F.avg("hit").alias("hit_rate"))
    return per.crossJoin(F.broadcast(base)).select("band", "n_pairs", "hit_rate", (F.col("hit_rate") / F.col("base")).alias("lift"))


def rank_correlation(scored: DataFrame, a: Column | str, b: Column | str, key: str = "query_id") -> DataFrame:
    """Spearman's correlation of two orders of each query's pool, equals by id."""
    place = lambda c: F.row_number().over(Window.partitionBy(key).orderBy(F.desc(c), "item_id")).cast("double")
    both = scored.select(key, place(a).alias("x"), place(b).alias("y"))
    return both.groupBy(key).agg(F.count("*").alias("n"), F.corr("x", "y").alias("rho"))


def hit_rate(log: DataFrame, stored: DataFrame, key: str = "query_id") -> DataFrame:
    """Share of logged queries that a stored table answers."""
    keys = stored.select(key).distinct().withColumn("hit", F.lit(1))
    return log.join(keys, key, "left").agg(F.count("*").alias("n"), F.avg(F.coalesce("hit", F.lit(0))).alias("hit_rate"))


# Texts that read as absent, and tags that no result page should show.
ABSENT = ("", "-", "--", "n/a", "na", "none", "unknown", "untitled", "?", "tbd")
SUSPECT_TAGS = {
    "not-a-game": r"^not a game$",
    "tool/utility": r"^(tool|utility|utilities|authoring system|development system)$",
    "library/extension": r"^(library|extension|code library|inform 7 extension)$",
    "index/catalogue": r"^(index|catalog|catalogue|directory|list of games)$",
    "review/essay": r"^(review|reviews|essay|article|criticism)$",
    "unplayable": r"^(unfinished|incomplete|abandoned|broken|non-working)$",
    "template/sample": r"^(template|sample|test|example|placeholder)$",
    "collection": r"^(collection|anthology|compilation)$",
}


def surfaced(pages: DataFrame, most: int = 3) -> DataFrame:
    """item_id, seen_in: every item of the pages (mode, key, item_id) once, with the first
    ``most`` of the ``mode:key`` that show it."""
    seen = pages.select("item_id", F.concat_ws(":", "mode", "key").alias("by")).distinct()
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("by"))
    few = seen.withColumn("_p", place).where(F.col("_p") <= most)
    return few.groupBy("item_id").agg(F.array_sort(F.collect_list("by")).alias("seen_in"))


def audit(pages: DataFrame, items: DataFrame, suspect: dict[str, str] | None = None) -> DataFrame:
    """issue, item_id, tag, seen_in: the faults of all items that result pages show.

    pages: mode, key, item_id; items: item_id, title, author, year, tags, system, description.
    An item counts once, however many pages show it; one that the catalogue lacks has all
    fields blank.  A suspect tag matches a pattern as a whole, in any case; each such tag is
    a row.
    """
    text = lambda c: F.lower(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"^\s+|\s+$", ""))
    fault = lambda issue, tag=None: F.struct(F.lit(issue).alias("issue"), (F.lit(None).cast("string") if tag is None else tag).alias("tag"))
    names = {"title": "empty title", "author": "empty author", "year": "missing year", "system": "no system", "description": "no description"}
    tags = T.split_values("tags", ",")
    blank = [F.when(text(c).isin(*ABSENT), fault(issue)) for c, issue in names.items()]
    blank.append(F.when(F.size(tags) == 0, fault("no tags")))
    bad = [_suspects(tags, name, pattern, fault) for name, pattern in (suspect or SUSPECT_TAGS).items()]
    shown = surfaced(pages).join(items.select("item_id", *names, "tags"), "item_id", "left")
    faults = F.concat(F.array_compact(F.array(*blank)), *bad)
    return shown.select("item_id", "seen_in", F.explode(faults).alias("f")).select("f.issue", "item_id", "f.tag", "seen_in")


def _suspects(tags: Column, name: str, pattern: str, fault) -> Column:
    return F.transform(F.filter(tags, lambda t: F.lower(t).rlike(pattern)), lambda t: fault(f"suspect tag: {name}", t))


def audit_summary(asked: DataFrame, pages: DataFrame, faults: DataFrame) -> DataFrame:
    """issue, n_items, n: items and rows of each fault, with the queries of each mode that were
    run, and those that gave an empty page (n_items: 0)."""
    empty = asked.join(pages.select("mode", "key").distinct(), ["mode", "key"], "left_anti")
    counted = lambda rows, label: rows.groupBy(F.concat(F.lit(label), F.col("mode")).alias("issue")).agg(F.lit(0).cast("long").alias("n_items"), F.count("*").alias("n"))
    found = faults.groupBy("issue").agg(F.countDistinct("item_id").alias("n_items"), F.count("*").alias("n"))
    return found.unionByName(counted(asked, "queries: ")).unionByName(counted(empty, "empty queries: "))
