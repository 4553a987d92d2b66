"""Queries that run a finite table through the streaming operators."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recoflow.plans.registry import query
from recoflow.sources.tables import scratch
from recoflow.streaming.tastes import recent_tastes, sessions, upsert_profiles

SLICE_DAYS = 5


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def arrive(events: DataFrame, inbox: str, days: int = SLICE_DAYS) -> None:
    """Write a table as files that arrive in order of time, ``days`` at a time, as a log would;
    within a slice rows are in any order, so nothing is sorted."""
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    while first is not None and first <= last:
        end = first + timedelta(days=days)
        events.where((F.col("ts") >= F.lit(first)) & (F.col("ts") < F.lit(end))).write.mode("append").parquet(inbox)
        first = end


@query("x01_streaming_tastes", "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_liked, CAST(round(sum(value) * 100) AS BIGINT) AS cents FROM events WHERE event_type = 'purchase' GROUP BY 1, 2")
def x01(spark: SparkSession, sf: str) -> DataFrame:
    """Events read as a stream, daily windows under a watermark of two slices, which closes
    windows as the stream goes on; profiles kept current by upserts; the result is the
    final state of all windows."""
    static, folder = _events(spark, sf), scratch(spark)
    arrive(static, f"{folder}/inbox")
    stream = spark.readStream.schema(static.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/inbox")
    windows = recent_tastes(stream.where(F.col("event_type") == "purchase"), "1 day", "1 day", lateness=f"{2 * SLICE_DAYS} days")
    found = upsert_profiles(windows, f"{folder}/state", f"{folder}/checkpoint-{uuid.uuid4().hex}", ["user_id", "day"]).current()
    return found.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "n_liked", F.round(F.col("total") * 100).cast("long").alias("cents"))


@query("x02_sessions", """WITH p AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts FROM events),
  s AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, starts DESC ROWS UNBOUNDED PRECEDING) AS run FROM p)
  SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n FROM s GROUP BY user_id, run""")
def x02(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of all users with pauses of at most six hours."""
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return sessions(_events(spark, sf), "6 hours").select("user_id", shown("start"), shown("end"), "n")
