"""Operator 7: document fingerprints by winnowing.

Every k-gram of code points is hashed; of each window of w consecutive hashes the
least is chosen, the rightmost of equals.  So any passage of at least w + k - 1 code
points that two texts share leaves a common fingerprint.  Hash and position are
packed into one number, hash first and positions descending, so that a plain minimum
also settles ties; the minima of windows come from repeated pairwise minima over
shifted arrays.  Only DataFrame functions are used.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recoflow.llm.common import written

K, DOUBLINGS = 8, 3
#: Hashes in a window.
W = 1 << DOUBLINGS
POSITION_BITS = 28


def gram_hashes(text: Column, k: int = K) -> Column:
    """A hash (the upper 35 bits of 63) of every k code points of a text, and of a text of
    fewer than k, the empty one too, as a whole."""
    grams = F.when(F.char_length(text) < k, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1)))
    return F.transform(grams, lambda g: F.shiftleft(F.shiftrightunsigned(F.xxhash64(g), 64 - 63 + POSITION_BITS), POSITION_BITS))


def winnowed(df: DataFrame, hashes: str, out: str) -> DataFrame:
    """Adds ``out``: an array of (hash << 28 | 2**28 - 1 - position), positions from 0,
    ascending in position, of the hashes chosen from ``gram_hashes``.  Fewer than w hashes
    are one window.  Positions past 2**28 - 1 count as that."""
    largest = F.lit((1 << POSITION_BITS) - 1)
    df = df.withColumn(out, F.transform(hashes, lambda h, i: h.bitwiseOR(F.greatest(largest - i, F.lit(0)).cast("long"))))
    for step in range(DOUBLINGS):
        df = df.withColumn(out, F.zip_with(out, F.slice(out, (1 << step) + 1, F.size(out)), lambda a, b: F.least(a, b)))
    return df.withColumn(out, F.array_distinct(F.slice(out, 1, F.greatest(F.size(out) - (W - 1), F.lit(1)))))


def fingerprints(df: DataFrame, text: str, out: str, k: int = K) -> DataFrame:
    """Adds ``out``, the fingerprint of a text: its chosen hashes with their positions
    (see ``winnowed``); ``spelt`` makes a string of it that tells both."""
    return winnowed(df.withColumn(out, gram_hashes(F.col(text), k)), out, out)


def spelt(chosen: str) -> Column:
    """Chosen hashes and positions in order, as ``hash@position`` in hexadecimal."""
    largest = F.lit((1 << POSITION_BITS) - 1)
    each = F.transform(chosen, lambda x: F.concat(F.hex(F.shiftright(x, POSITION_BITS)), F.lit("@"), F.hex(largest - x.bitwiseAND(largest))))
    return F.lower(F.array_join(each, " "))


def hashes_of(chosen: str) -> Column:
    return F.array_distinct(F.transform(chosen, lambda x: F.shiftright(x, POSITION_BITS)))


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two sets of hashes."""
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def bucket_of(bounds: list[int], key: Column, tie: Column) -> Column:
    """Number of ``bounds`` (ascending) below ``key``, found by halving.  A key that is
    itself a bound m times over has the share of m + 1 buckets or so: the bits of ``tie``,
    in its order, deal its rows to m of them."""
    distinct = sorted(set(bounds))
    if not distinct:
        return F.lit(0).cast("long")
    limits = F.array(*[F.lit(b) for b in distinct]).cast("array<bigint>")
    span = F.struct(F.lit(0).alias("low"), F.lit(len(distinct)).alias("high"))

    def halve(x: Column, _: Column) -> Column:
        middle = F.shiftright(x["low"] + x["high"], 1)
        below = (x["low"] < x["high"]) & (F.get(limits, middle) < key)
        return F.struct(F.when(below, middle + 1).otherwise(x["low"]).alias("low"), F.when(below | (x["low"] >= x["high"]), x["high"]).otherwise(middle).alias("high"))

    at = F.aggregate(F.sequence(F.lit(1), F.lit(len(distinct).bit_length() + 1)), span, halve, lambda x: x["low"])
    times_of, first, seen = Counter(bounds), [], 0  # bucket of the first row of each bound
    for b in distinct:
        first.append(seen)
        seen += times_of[b]
    starts = F.array(*[F.lit(x) for x in [*first, seen]]).cast("array<bigint>")
    begin = F.get(starts, at)
    times = F.when(F.get(limits, at) == key, F.get(starts, at + 1) - begin).otherwise(F.lit(1))
    # the upper 31 bits of the tie, from 0, are its place between the least and the greatest
    place = F.shiftright(tie, 33) + (1 << 30)
    return begin + F.shiftright(place * times, 31)


def with_next(docs: DataFrame, bucket_docs: int = 1000) -> tuple[DataFrame, Window]:
    """doc_id, text, own (false for a guest), and the window of each bucket.

    Documents in order of doc_id (null last; equal ids by a hash of the text) fall into
    buckets of about ``bucket_docs`` by approximate percentiles; an id that many rows have
    (null, say) gets its share of buckets by that hash.  The first document of the next
    bucket (after the last one: of the first) is also a guest at the end of each bucket,
    so that lead() over a bucket finds every document's next one.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.coalesce("doc_id", F.lit(2**63 - 1)).alias("key"), F.xxhash64(text).alias("tie"))
    buckets = max(1, docs.count() // bucket_docs)
    bounds = keyed.select(F.percentile_approx("key", [k / buckets for k in range(1, buckets)], 10 * buckets)).first()[0] if buckets > 1 else None
    keyed = keyed.withColumn("bucket", bucket_of(bounds or [], F.col("key"), F.col("tie")))
    first = written(keyed.groupBy("bucket").agg(F.min(F.struct("key", "tie")).alias("f")))
    order = Window.orderBy("bucket")  # one row a bucket, without texts
    host = F.coalesce(F.lag("bucket").over(order), F.lit(-1))
    top = first.agg(F.max("bucket")).first()[0]
    first = first.select("f.*", F.when(host < 0, F.lit(top)).otherwise(host).alias("host"))
    guests = keyed.join(F.broadcast(written(first)), ["key", "tie"]).dropDuplicates(["key", "tie"])
    guests = guests.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(2**63 - 1).alias("key"), F.lit(2**63 - 1).alias("tie"), F.col("host").alias("bucket"), F.lit(False).alias("own"))
    every = keyed.withColumn("own", F.lit(True)).unionByName(guests)
    return every, Window.partitionBy("bucket").orderBy("key", "tie", F.desc("own"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (see
    ``spelt``), near_edited, near_next.

    The edited text has its last floor(n / 4) code points replaced by the first as many
    of the next document; the hashes of the grams before these are taken over.  Null text
    is empty; rows that repeat a doc_id follow each other; a null doc_id comes last; one
    document alone is its own next one; further columns are dropped; an empty table gives
    no rows.  A text is hashed in one task, so memory grows with the longest text only.
    """
    rows, order = with_next(docs)
    rows = rows.withColumn("next", F.lead("text").over(order)).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    stays = (F.col("n_chars") - cut).cast("int")
    rows = rows.withColumn("tail", F.substring(F.coalesce("next", F.lit("")), F.lit(1), cut)).drop("next")
    rows = rows.withColumn("edited_sha256", F.sha2(F.concat(F.substring("text", F.lit(1), stays), F.col("tail")), 256))
    # grams that end before the tail, and the code points of the text that others begin in
    whole = F.greatest(stays - (K - 1), F.lit(0))
    rows = rows.withColumn("tail", F.concat(F.substring("text", whole + 1, stays - whole), F.col("tail")))
    rows = rows.withColumn("hashes", gram_hashes(F.col("text"))).drop("text")
    rest = F.when((whole > 0) & (F.char_length("tail") < K), F.array().cast("array<bigint>")).otherwise(gram_hashes(F.col("tail")))
    rows = rows.withColumn("changed", F.concat(F.slice("hashes", F.lit(1), whole), rest)).drop("tail")
    rows = winnowed(winnowed(rows, "hashes", "chosen").drop("hashes"), "changed", "changed")
    rows = rows.withColumn("fingerprint", spelt("chosen")).withColumn("edited_fingerprint", spelt("changed"))
    rows = rows.withColumn("chosen", hashes_of("chosen")).withColumn("changed", hashes_of("changed"))
    rows = rows.withColumn("near_edited", likeness("chosen", "changed")).drop("changed")
    rows = rows.withColumn("after", F.lead("chosen").over(order)).where("own")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", likeness("chosen", "after").alias("near_next"))
