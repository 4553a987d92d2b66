"""Profile table by batches, late events, sessions."""

import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recoflow.streaming.queries import arrive
from recoflow.streaming.tastes import ProfileTable, recent_tastes, sessions, upsert_profiles

ROW = "user_id long, day string, n long"
START = datetime(2024, 1, 1)


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}"


def profile_table(spark, root):
    return ProfileTable(spark, root, ["user_id", "day"], spark.createDataFrame([], ROW).schema, buckets=8)


def rows_of(table):
    return {(r.user_id, r.day): r.n for r in table.current().collect()}


def test_batches_give_the_newest_row_of_each_key(spark, folder):
    table, want, rng = profile_table(spark, folder), {}, random.Random(3)
    assert rows_of(table) == {}
    for number in range(4):
        batch = {(rng.choice([None, *range(12)]), rng.choice(["a", None])): number * 100 + i for i in range(10)}
        want |= batch
        assert table.merge(spark.createDataFrame([(*k, n) for k, n in batch.items()], ROW), "s", number)
        assert rows_of(table) == want
    assert table.current().count() == len(want)


def test_a_batch_rewrites_only_its_buckets_and_counts_once(spark, folder):
    table = profile_table(spark, folder)
    table.merge(spark.createDataFrame([(i, "a", i) for i in range(40)], ROW), "s", 0)
    before = table.manifest()["layers"]
    one = spark.createDataFrame([(7, "a", 700)], ROW)
    table.merge(one, "s", 1)
    after = table.manifest()["layers"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert not table.merge(spark.createDataFrame([(7, "a", -1)], ROW), "s", 1)
    assert rows_of(table)[7, "a"] == 700
    # another stream has numbers of its own
    assert table.merge(spark.createDataFrame([(7, "a", 5)], ROW), "other", 0)
    assert rows_of(table) == {(i, "a"): i for i in range(40)} | {(7, "a"): 5}
    assert table.merge(one.limit(0), "s", 2) and len(rows_of(table)) == 40


def test_a_batch_that_dies_before_its_commit_leaves_the_table(spark, folder, monkeypatch):
    table = profile_table(spark, folder)
    table.merge(spark.createDataFrame([(1, "a", 1)], ROW), "s", 0)
    with monkeypatch.context() as m:
        m.setattr(ProfileTable, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            table.merge(spark.createDataFrame([(1, "a", 2)], ROW), "s", 1)
    assert rows_of(table) == {(1, "a"): 1}
    assert table.merge(spark.createDataFrame([(1, "a", 2)], ROW), "s", 1)
    assert rows_of(table) == {(1, "a"): 2}
    assert table.vacuum(1) == 2 and rows_of(table) == {(1, "a"): 2}


def test_late_events_are_dropped_and_late_within_bounds_count(spark, folder):
    day = lambda d, h=0: START + timedelta(days=d, hours=h)
    steps = [[(1, day(0), 1.0), (2, day(0), 1.0)], [(1, day(5), 1.0)], [(1, day(0, 1), 9.0), (1, day(4), 1.0)], [(2, day(9), 1.0)]]
    inbox, state, check = f"{folder}/in", f"{folder}/state", f"{folder}/check"
    for events in steps:
        spark.createDataFrame(events, "user_id long, ts timestamp, value double").coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema("user_id long, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(inbox)
        table = upsert_profiles(recent_tastes(stream, "1 day", "1 day", "2 days"), state, check, ["user_id", "day"], 4)
    got = {(r.user_id, (r.day - START).days): (r.n_liked, r.total) for r in table.current().collect()}
    # the event of day 0 that came after day 5 is too late; that of day 4 is not
    assert got == {(1, 0): (1, 1.0), (2, 0): (1, 1.0), (1, 5): (1, 1.0), (1, 4): (1, 1.0), (2, 9): (1, 1.0)}


def events_of(spark):
    rng = random.Random(5)
    rows = [(u, START + timedelta(minutes=rng.randrange(0, 60 * 24 * 3)), 1.0) for u in (1, 2, 3) for _ in range(40)]
    return spark.createDataFrame([*rows, (4, START, 1.0), (4, START + timedelta(minutes=30), 1.0)], "user_id long, ts timestamp, value double")


def runs(rows, gap):
    out, by = [], {}
    for u, ts, _ in rows:
        by.setdefault(u, []).append(ts)
    for u, times in by.items():
        times.sort()
        first, last, n = times[0], times[0], 0
        for t in times:
            if t - last > gap:
                out.append((u, first, last + gap, n))
                first, n = t, 0
            last, n = t, n + 1
        out.append((u, first, last + gap, n))
    return sorted(out)


def test_sessions_of_a_table_and_of_a_stream(spark, folder):
    events, gap = events_of(spark), timedelta(minutes=30)
    want = runs([tuple(r) for r in events.collect()], gap)
    assert sorted(map(tuple, sessions(events).collect())) == want
    arrive(events, f"{folder}/in", days=1)
    name = f"sessions_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    run = sessions(stream, lateness="2 days").writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    run.awaitTermination()
    closed = events.agg(F.max("ts")).first()[0] - timedelta(days=2)
    got = sorted(map(tuple, spark.table(name).collect()))
    assert got == [s for s in want if s[2] <= closed] and got


def test_an_empty_stream_gives_an_empty_table(spark, folder):
    empty = events_of(spark).limit(0)
    arrive(empty, f"{folder}/none")
    empty.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(empty.schema).parquet(f"{folder}/in")
    found = upsert_profiles(recent_tastes(stream, "1 day", "1 day"), f"{folder}/s", f"{folder}/c", ["user_id", "day"]).current()
    assert found.count() == 0 and found.columns == ["user_id", "day", "n_liked", "total"]
