"""Numbered runs against a walk row by row, with threads over many partitions."""

import random

import pytest
from pyspark.sql import functions as F

from keepsake.operators import conversations as cv
from keepsake.operators.walks import gap_sizes, numbered_runs

SCHEMA = "thread_id string, unit_id long, start_ts long, end_ts long, tokens long, piece_of long, hard long"


def rows(seed=1, n=700, hot=0.5, barriers=0.05):
    rng, out, at = random.Random(seed), [], 0
    for unit in range(n):
        at += rng.choice([0, 0, 5, 30, 60, 90]) + (1000 if rng.random() < barriers else 0)
        thread = "hot" if rng.random() < hot else rng.choice(["a", "b", "c", None, "z"])
        piece = out[-1][5] if out and rng.random() < 0.3 and out[-1][0] == thread else (unit if rng.random() < 0.9 else None)
        out.append((thread, unit, at, at + rng.choice([0, 0, 10, 200]), rng.choice([0, 1, 5, 20, 60]), piece, rng.choice([300, 300, 500])))
    return out


def walk(rows, gap, least, cap, piece):
    state, out = {}, {}
    for thread, unit, start, end, tokens, own, hard in sorted(rows, key=lambda r: (r[2], r[1])):
        number, held, last, last_piece = state.get(thread, (1, 0, None, None))
        same = piece and own is not None and own == last_piece
        if last is not None and (start - last > hard or not same and ((start - last > gap and held >= least) or held + tokens > cap)):
            number, held = number + 1, 0
        state[thread] = (number, held + tokens, end, own)
        out[unit] = number
    return out


@pytest.mark.parametrize("gap,least,cap,barriers", [(50, 40, 100, 0.05), (50, 40, 100, 0.0), (20, 0, 30, 0.3), (float("inf"), 0, 64, 0.0), (10, 1000, 900, 0.01), (50, 40, 0, 0.0)])
@pytest.mark.parametrize("piece", [None, "piece_of"])
def test_is_the_walk(spark, gap, least, cap, barriers, piece):
    data = rows(seed=int(cap + barriers * 100), barriers=barriers)
    units = spark.createDataFrame(data, SCHEMA).repartition(3)
    for partitions in (1, 13):
        got = numbered_runs(units, "thread_id", ["start_ts", "unit_id"], "no", hard=F.col("hard"), gap=gap, least=least, cap=cap, piece=piece, partitions=partitions)
        assert got.columns == [*units.columns, "no"]
        assert {r.unit_id: r.no for r in got.collect()} == walk(data, gap, least, cap, piece)


def test_small_batches(spark):
    """A thread goes over many batches of a partition, too."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    data, before = rows(seed=9, barriers=0.01), spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        got = numbered_runs(spark.createDataFrame(data, SCHEMA), "thread_id", ["start_ts", "unit_id"], "no", hard=F.col("hard"), gap=50, least=40, cap=100, piece="piece_of", partitions=3).collect()
    finally:
        spark.conf.set(key, before)
    assert {r.unit_id: r.no for r in got} == walk(data, 50, 40, 100, "piece_of")


def test_one_thread_is_many_tasks(spark):
    units = spark.createDataFrame([("one", k, 60 * k, 60 * k, 10, k, 10**9) for k in range(4000)], SCHEMA)
    out = cv.sessions(units.drop("piece_of"), cap=300)
    assert out.rdd.getNumPartitions() == 4
    sizes = [n for n in out.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()]
    assert sum(sizes) == 4000 and max(sizes) < 2000
    assert sorted(map(tuple, out.groupBy("session_no").count().collect())) == [(k + 1, 30 if k < 133 else 10) for k in range(134)]


def test_gaps_and_bursts(spark):
    data = rows(seed=4)
    units = spark.createDataFrame(data, SCHEMA).drop("piece_of", "hard")
    want = []
    last = {}
    for thread, _, start, end, *_ in sorted(data, key=lambda r: (r[2], r[1])):
        want.append((thread or "", start - last[thread] if thread in last else -1e9))
        last[thread] = end
    got = [(r.thread_id or "", -1e9 if r.gap is None else r.gap) for r in gap_sizes(units, "thread_id", ["start_ts", "unit_id"]).collect()]
    assert sorted(got) == sorted(want)
    bursts = cv.bursts(units, cap=100, shortest=10, longest=100)
    assert bursts.columns == [*units.columns, "burst_no"] and bursts.count() == len(data)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert cv.sessions(none).count() == 0 and cv.bursts(none.drop("piece_of", "hard")).count() == 0
