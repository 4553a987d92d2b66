"""What the operators share: the shared folder, written tables, joins on hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Arrow hands to a Python worker at once; documents can be long.
ARROW_ROWS = 1000
#: A key with more than this share of a table's rows is hot; there are fewer than
#: HOT_KEYS of them, whatever the table.
HOT_KEYS = 2000


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where that setting is missing, a temporary folder stands in for it in local mode; on
    a cluster that is an error, as executors would not see each other's files.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = base.get() if base.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The frame written as Parquet to the shared folder and read again: it cuts the
    lineage and outlives lost executors."""
    spark = df.sparkSession
    path = folder or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and further columns; all other columns are dropped."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def whole_row(df: DataFrame, name: str) -> Column:
    """All columns as one struct, so that no helper column can clash with one of them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def hot_keys(counts: DataFrame, count: str, total: int) -> DataFrame:
    """The rows of ``counts`` (one a key) whose key has more than a share of 1 / HOT_KEYS
    of ``total`` rows; fewer than HOT_KEYS by counting, so they may be broadcast."""
    return counts.where(F.col(count) * HOT_KEYS > total)


def spread_join(rows: DataFrame, side: DataFrame, key: str, by: str, counts: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``side`` on ``key`` that splits hot keys.

    A key with a share s of the rows is cut into about s * HOT_KEYS parts by a hash of
    column ``by``, and its row of ``side`` is copied to each part: at most 2 * HOT_KEYS
    copies in all.  counts: key, n of the rows, and total, their number, where these are
    known already; otherwise ``rows`` is read three times and should be a written table.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    total = rows.count() if total is None else total
    hot = hot_keys(counts, "n", total).select(key, F.ceil(F.col("n") * HOT_KEYS / max(1, total)).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_parts")
    copied = side.join(F.broadcast(hot), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copied, [key, "_part"]).drop("_part")
