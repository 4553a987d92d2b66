"""Vectors: normalising, averaging, threshold and nearest search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recoflow.operators.blocks import BLOCK, CellIndex


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: str | Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: str) -> Column:
    """The vector over its length; zero stays."""
    length = norm(v)
    return F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length)).otherwise(F.transform(v, lambda x: x.cast("double")))


def seed_average(seeds: DataFrame, vectors: DataFrame, key: str = "query_id") -> DataFrame:
    """Mean of the unit vectors of a key's seeds, made unit again; unknown seeds do not
    count (I4).  Averages each dimension as a group of its own."""
    each = seeds.join(vectors.select("item_id", unit("vector").alias("v")), "item_id").select(key, F.posexplode("v").alias("pos", "x"))
    means = each.groupBy(key, "pos").agg(F.avg("x").alias("x"))
    mean = means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("v"))
    return mean.select(key, unit("v").alias("vector"))


def seed_space(query_vectors: DataFrame, doc_vectors: DataFrame) -> DataFrame:
    """item_id, vector: the space that seeds are averaged in (I4): the query encoder's vectors
    of items, so that a mean lies where query texts do; the documents' vectors where the
    query encoder gave none at all.  The spaces are never mixed: a seed that only the
    documents have does not count while there are query vectors."""
    double = F.transform("vector", lambda x: x.cast("double")).alias("vector")
    none = query_vectors.limit(1).agg((F.count("*") == 0).alias("_none"))  # one row
    docs = doc_vectors.select("item_id", double).crossJoin(F.broadcast(none)).where("_none").drop("_none")
    return query_vectors.select("item_id", double).unionByName(docs)


def centred(vectors: DataFrame) -> DataFrame:
    """Vectors less the mean of all; dimensions are averaged as groups."""
    means = vectors.select(F.posexplode("vector").alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("_mean"))  # one row
    return vectors.crossJoin(F.broadcast(mean)).withColumn("vector", F.zip_with("vector", "_mean", lambda x, m: x.cast("double") - m)).drop("_mean")


def above(queries: DataFrame, items: DataFrame, floor: float, block: int = BLOCK, most: int | None = None) -> DataFrame:
    """query_id, item_id, cos: the threshold join.

    queries: query_id, vector; items: item_id, vector.  Items are put into cells; a query
    meets only the cells whose bound reaches the floor, in matrix products with the items
    that a task holds.  Only pairs at or above the floor leave it, of these the ``most`` best
    a query and task.  To search the same items again, keep a ``CellIndex``.
    """
    return CellIndex(items, block=block).search(queries, floor, most)


def nearest(queries: DataFrame, items: DataFrame, k: int, block: int = BLOCK, digits: int | None = None) -> DataFrame:
    """The k highest inner products of each query with rank, equals by id (G1); k of each
    bin leave its task.  With ``digits``, inner products are rounded before they are compared,
    so that ones which look equal go by id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("cos"), "item_id")
    return CellIndex(items, block=block).search(queries, most=k, digits=digits).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def approximate(queries: DataFrame, items: DataFrame, floor: float, target: float = 0.97, cells: int | None = None) -> DataFrame:
    """Pairs at or above a floor, by an inverted file (I6): a query looks into the cells that
    should hold the share ``target`` of its pairs; what it finds there is exact."""
    return CellIndex(items, cells).search(queries, floor, target=target)


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the true pairs that were found; 1 if there are none."""
    pairs = ["query_id", "item_id"]
    hits = truth.select(*pairs).join(found.select(*pairs).withColumn("hit", F.lit(1)), pairs, "left")
    return hits.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0))).first()[0]


def embed(docs: DataFrame, key: str, text: str, features: int = 256) -> DataFrame:
    """Unit vectors of texts by hashed term counts, inverse document frequency and
    normalising (I1; over query texts, I2)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    steps = [RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"\W+"), HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="_v")]
    source = docs.select(key, F.coalesce(text, F.lit("")).alias("_text"))
    return Pipeline(stages=steps).fit(source).transform(source).select(key, vector_to_array("_v").alias("vector"))


def encode_with(docs: DataFrame, key: str, text: str, make_encoder, key_type: str = "long") -> DataFrame:
    """Vectors by a user's encoder: ``make_encoder()`` runs once a partition and gives a
    function from a list of texts to a matrix (the hook of I1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "vector": list(np.asarray(encode(pdf[text].fillna("").tolist()), np.float64))})

    return docs.select(key, text).mapInPandas(run, f"{key} {key_type}, vector array<double>")
