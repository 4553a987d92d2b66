"""Reading and writing tables: ingest, manifests, ranking tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir or the session's checkpoint folder; a local one
    only in local mode without either, as on a cluster others would not see it."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = chosen.get() if chosen.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load(spark: SparkSession, source: str, kind: str = "parquet", **options: str) -> DataFrame:
    """A table from Parquet, CSV, JSON or, with ``kind="jdbc"``, from a database (A1)."""
    reader = spark.read.options(**options)
    return reader.format("jdbc").option("dbtable", source).load() if kind == "jdbc" else reader.format(kind).load(source)


def normalised_ids(df: DataFrame, target: str, aliases: tuple[str, ...]) -> DataFrame:
    """The first alias there is becomes ``target``, unless that is there already (A2)."""
    if target in df.columns:
        return df
    found = next((a for a in aliases if a in df.columns), None)
    return df if found is None else df.withColumnRenamed(found, target)


def as_text(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """All columns but those of ``keep`` as strings, nulls kept (A3)."""
    return df.select(*[F.col(c) if c in keep else F.col(c).cast("string").alias(c) for c in df.columns])


def ordered(df: DataFrame, *keys: str) -> DataFrame:
    """Rows in key order, without keys in order of all columns (A4)."""
    return df.orderBy(*(keys or df.columns))


def numbered(df: DataFrame, key: str, bucket_rows: int = 1_000_000, most_buckets: int = 2000) -> DataFrame:
    """Adds place: the row's number in key order, counted by ranges of the key, so that
    no task sees the whole table; as many ranges as its rows ask for."""
    buckets = max(2, min(most_buckets, -(-df.count() // bucket_rows)))
    bounds = df.select(F.percentile_approx(key, [k / buckets for k in range(1, buckets)], 100 * buckets)).first()[0] or []
    limits = F.array(*[F.lit(b) for b in sorted(set(bounds))]).cast(f"array<{df.schema[key].dataType.simpleString()}>")
    cut = df.withColumn("_b", F.size(F.filter(limits, lambda b: b < F.col(key))))
    before = cut.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_b")) - F.col("_n"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy(key))
    return cut.withColumn("_p", place).join(F.broadcast(before), "_b").withColumn("place", (F.col("_p") + F.col("_before")).cast("long")).drop("_b", "_n", "_before", "_p")


def ingest(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write a table as Parquet; what is there already stays unless overwritten (A5)."""
    df.write.mode("overwrite" if overwrite else "ignore").parquet(path)


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Some columns of a Parquet table; a missing one is an error that names it."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no table at {path}: ingest it first")
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n_rows, columns, digest of each table; the digest does not depend on the
    order or the number of files (A6)."""
    out = []
    for name, df in tables.items():
        h = F.xxhash64(*df.columns)
        facts = df.agg(F.count("*").alias("n_rows"), F.hex(F.coalesce(F.bit_xor(h), F.lit(0))).alias("a"), F.hex(F.coalesce(F.sum(F.pmod(h, F.lit(2147483647))), F.lit(0))).alias("b"))
        out.append(facts.select(F.lit(name).alias("name"), "n_rows", F.lit(",".join(df.columns)).alias("columns"), F.concat("a", F.lit("-"), "b").alias("digest")))
    first, *rest = out
    for more in rest:
        first = first.unionByName(more)
    return first


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """name, status (added, removed, changed) of the tables that differ."""
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, F.col("a.name") == F.col("b.name"), "full")
    same = F.col("a.digest").eqNullSafe(F.col("b.digest")) & F.col("a.columns").eqNullSafe(F.col("b.columns")) & F.col("a.n_rows").eqNullSafe(F.col("b.n_rows"))
    status = F.when(F.col("a.name").isNull(), "added").when(F.col("b.name").isNull(), "removed").when(~same, "changed")
    return both.select(F.coalesce("a.name", "b.name").alias("name"), status.alias("status")).where(F.col("status").isNotNull())


RANKING = "key string, item_id long, score double, relevance double, rank long"


def publish_ranking(rankings: DataFrame, path: str) -> None:
    """Write a ranking table beside its place, each key together and in rank order, and
    move it there when whole (A9).  What was there is moved aside first and deleted last;
    if the move fails, it is put back."""
    spark = rankings.sparkSession
    beside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    columns = [F.col(part.split()[0]).cast(part.split()[1]) for part in RANKING.split(", ")]
    rankings.select(*columns).repartition("key").sortWithinPartitions("key", "rank").write.parquet(beside)
    jvm = spark.sparkContext._jvm
    source, target, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (beside, path, f"{beside}-old"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    replaces = fs.exists(target)
    if replaces and not fs.rename(target, old):
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(source, target):
        if replaces:
            fs.rename(old, target)
        raise OSError(f"{beside} can't be moved to {path}")
    if replaces:
        fs.delete(old, True)


def stored_ranking(spark: SparkSession, path: str, excluded: DataFrame | None = None) -> DataFrame:
    """A stored ranking without excluded items; empty where none is stored."""
    if not exists(spark, path):
        return spark.createDataFrame([], RANKING)
    found = spark.read.parquet(path)
    return found if excluded is None else found.join(excluded.select("item_id"), "item_id", "left_anti").select(found.columns)
