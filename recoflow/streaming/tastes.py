"""Streaming taste profiles: windows over recent positives, kept current by upserts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recoflow.sources.versions import VersionedFolder


def recent_tastes(events: DataFrame, width: str, slide: str, lateness: str = "1 day") -> DataFrame:
    """user_id, day (start of the window), n_liked, total per sliding window; events later
    than ``lateness`` are dropped, and the state of closed windows with them."""
    span = F.window("ts", width, slide)
    seen = events.withWatermark("ts", lateness).groupBy("user_id", span.alias("w"))
    return seen.agg(F.count("*").alias("n_liked"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("day"), "n_liked", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 day") -> DataFrame:
    """Sessions of a user: runs of events with no pause longer than ``gap``; ``end`` is a gap
    after the last event.  Streams give a session once, when the watermark has passed it;
    tables give all of them."""
    run = F.session_window("ts", gap)
    return events.withWatermark("ts", lateness).groupBy("user_id", run.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class ProfileTable(VersionedFolder):
    """The newest row of each key, kept in buckets by key; a batch rewrites only the buckets
    that hold one of its keys.

    buckets: fixed for the life of a table, so many that one fits a task.  Old layers stay
    for readers of old versions until ``vacuum``.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], schema: StructType, buckets: int = 32):
        super().__init__(spark, root)
        self.keys, self.schema, self.buckets = keys, schema, buckets

    def _rows(self, numbers: Iterable[int] | None = None) -> DataFrame:
        layers = (self.manifest() or {"layers": {}})["layers"]
        paths = [f"{path}/_bucket={b}" for b, path in layers.items() if numbers is None or int(b) in numbers]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def current(self) -> DataFrame:
        """All keys' newest rows; none before the first batch."""
        return self._rows()

    def merge(self, batch: DataFrame, stream: str, number: int) -> bool:
        """Put the rows of a batch, one a key, in the place of their keys' rows; False if this
        stream's batch is there already, as after a retry."""
        before = self.manifest() or {"version": 0, "layers": {}, "streams": {}}
        if before["streams"].get(stream, -1) >= number:
            return False
        place = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).alias("_bucket")
        rows = batch.select(*self.schema.names, place).persist()
        try:
            touched = {r[0] for r in rows.select("_bucket").distinct().collect()}  # at most ``buckets``
            layers = dict(before["layers"])
            if touched:
                same = F.lit(True)
                new = rows.select(*[F.col(k).alias(f"_{k}") for k in self.keys])
                for k in self.keys:
                    same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
                kept = self._rows(touched).join(new, same, "left_anti").select("*", place)
                path = f"{self.root}/layers/{uuid.uuid4().hex}"
                kept.unionByName(rows).repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(path)
                layers |= {str(b): path for b in touched}
        finally:
            rows.unpersist()
        self._commit({"version": before["version"] + 1, "layers": layers, "streams": before["streams"] | {stream: number}})
        return True


def upsert_profiles(updates: DataFrame, state: str, checkpoint: str, keys: list[str], buckets: int = 32) -> ProfileTable:
    """Process all that is there and merge each batch into the table at ``state``.

    A batch changes only the buckets of its own keys and is committed by one rename with its
    number, so a repeated batch changes nothing; the checkpoint's path names the stream.
    """
    table = ProfileTable(updates.sparkSession, state, keys, StructType.fromJson(json.loads(updates.schema.json())), buckets)

    def add(batch: DataFrame, number: int) -> None:
        table.merge(batch, checkpoint, number)

    run = updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(add).start()
    run.awaitTermination()
    return table
