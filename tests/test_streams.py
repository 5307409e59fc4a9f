"""Sessions as a stream: out of order, late, stopped and gone on; parts of a feed in their order."""

import random

import pytest
from pyspark.sql import functions as F

from keepsake.operators import conversations as cv
from keepsake.streaming import feeds
from keepsake.streaming.sessions import Replay

SCHEMA = "thread_id long, unit_id long, start_ts long, end_ts long, tokens long, part int"
DAY = 86_400


@pytest.fixture(scope="module")
def units(spark):
    rng, rows, unit = random.Random(6), [], 0
    for thread in range(6):
        at = 1_700_000_000
        for _ in range(rng.randint(1, 60)):
            at += rng.choice([0, 10, 600, 2699, 2701, 5000, DAY - 1, DAY, DAY + 1, 3 * DAY])
            rows.append((thread, unit, at, at + rng.choice([0, 0, 300]), rng.choice([5, 40, 119, 120, 250, 400]), rng.randint(0, 4)))
            unit += 1
    return spark.createDataFrame(rows, SCHEMA)


def walked(units):
    each = cv.sessions(units.drop("part"), cap=300).groupBy("thread_id", "session_no").agg(F.count("*").alias("n"), F.min("start_ts").alias("a"))
    return sorted(map(tuple, each.collect()))


def streamed_rows(replay):
    return sorted(tuple(r) for r in replay.sessions().select("thread_id", "session_no", "n", "a").collect())


def delivered(spark, units, delay, parts):
    out = Replay(spark, units.drop("part").schema, delay, cap=300)
    for k in parts:
        out.deliver(units.filter(F.col("part") == k).drop("part"))
    return out


def test_any_order_within_the_delay_and_a_restart(spark, units):
    """Parts are a random deal of the events; the delay covers them all. The stream stops after three parts and goes on."""
    replay = delivered(spark, units, "400 days", [3, 0, 4])
    replay.run()
    assert replay.sessions().isEmpty()  # nothing is due yet
    for k in (1, 2):
        replay.deliver(units.filter(F.col("part") == k).drop("part"))
    replay.close()
    replay.run()
    want = walked(units)
    assert streamed_rows(replay) == want and replay.late().isEmpty()
    replay.run()  # nothing new: nothing changes
    assert streamed_rows(replay) == want


def test_a_timer_closes_a_session(spark):
    """Thread 1 says no more; its session leaves when others' events have moved the watermark a day past it, and an event behind the watermark comes out as late."""
    rows = [(1, 1, 0, 0, 50, 0), (1, 2, 100, 100, 50, 0), (2, 3, DAY + 50, DAY + 50, 9, 1), (2, 4, 2 * DAY, 2 * DAY, 9, 2), (1, 5, 200, 200, 50, 3), (1, 6, 3 * DAY, 3 * DAY, 7, 3)]
    units = spark.createDataFrame(rows, SCHEMA)
    replay = delivered(spark, units, "1 hour", [0, 1])
    replay.run()
    assert streamed_rows(replay) == []
    replay.deliver(units.filter("part = 2").drop("part"))
    replay.run()
    assert streamed_rows(replay) == [(1, 1, 2, 0)]
    replay.deliver(units.filter("part = 3").drop("part"))
    replay.close()
    replay.run()
    assert streamed_rows(replay) == [(1, 1, 2, 0), (1, 2, 1, 3 * DAY), (2, 1, 2, DAY + 50)]
    assert [tuple(r) for r in replay.late().collect()] == [(1, 5, 200)]


def test_many_files_a_delivery_and_threads_a_step(spark, units):
    """A delivery is written by its tasks, not by one; threads that share a bucket, one without an id among them, are walked each by itself."""
    given = units.withColumn("thread_id", F.when(F.col("thread_id") != 2, F.col("thread_id"))).repartition(3)
    replay = Replay(spark, units.drop("part").schema, "400 days", buckets=2, cap=300)
    for k in range(2):
        replay.deliver(given.filter(F.col("part") % 2 == k).drop("part"))
    replay.close()
    replay.run()
    assert len(spark.read.parquet(f"{replay.source}/part=0").inputFiles()) > 1
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = walked(units)
    assert sorted(((None if r[0] == 2 else r[0], *r[1:]) for r in want), key=key) == sorted((tuple(r) for r in replay.sessions().select("thread_id", "session_no", "n", "a").collect()), key=key)


def test_parts_come_in_order_of_time(spark, units):
    """No row is late under a watermark without delay; rows without a time go first and are lost to windows only."""
    rows = units.select(F.timestamp_seconds("start_ts").alias("at"), "thread_id").repartition(7)
    out = feeds.streamed(spark, rows, "at", lambda s: s.withWatermark("at", "0 seconds").groupBy("thread_id").agg(F.count("*").alias("n")), parts=5)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, units.groupBy("thread_id").count().collect()))
    out = feeds.streamed(spark, rows, "at", lambda s: s.withWatermark("at", "0 seconds").groupBy("thread_id", F.session_window("at", "1 day")).count(), parts=5)
    assert out.agg(F.sum("count")).first()[0] == units.count()
    assert feeds.streamed(spark, rows.limit(0), "at", lambda s: s.groupBy("thread_id").count()).count() == 0


@pytest.mark.parametrize("name,gap", [("wn04_session_window", 2700), ("ss03_session_windows", 86_400)])
def test_a_row_at_the_very_gap_opens_a_session(spark, tmp_path, name, gap):
    from keepsake.plans import registry

    at = [0, gap - 1, 2 * gap - 1, 3 * gap - 2, 4 * gap - 1]
    rows = spark.createDataFrame([(k, 1_704_067_200 + t, 7, "view", 1.0) for k, t in enumerate(at)], "event_id long, s long, user_id long, event_type string, value double")
    rows.select("event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    got = registry.queries()[name](spark, str(tmp_path))
    assert sorted((r[2] - 1_704_067_200, r[1]) for r in got.collect()) == [(0, 2), (2 * gap - 1, 2), (4 * gap - 1, 1)]
