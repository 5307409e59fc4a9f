"""Order statistics by histograms against sorted lists."""

import random
import statistics

import pytest

from keepsake.operators import selection


def data():
    rng = random.Random(3)
    hot = [("hot", rng.choice([rng.gauss(0, 1e6), float(rng.randint(0, 5)), rng.expovariate(1e-9)])) for _ in range(3000)]
    rows = [*hot, *(("same", 7.5) for _ in range(500)), ("one", 1.0), ("two", 1.0), ("two", 4.0), (None, 3.0), (None, 9.0), (None, None), ("none", None)]
    rows += [("ends", v) for v in [float("nan")] * 3 + [float("inf")] * 5 + [float("-inf")] * 4 + [rng.random() for _ in range(50)] + [1.7e308, -1.7e308]]
    return rows


@pytest.fixture(scope="module")
def values(spark):
    return spark.createDataFrame(data(), "g string, v double").repartition(4)


def groups():
    out = {}
    for g, v in data():
        if v is not None:
            out.setdefault(g, []).append(v)
    return {g: sorted(v, key=lambda x: (x != x, x)) for g, v in out.items()}


@pytest.mark.parametrize("small,buckets,broadcast", [(10_000, 1024, 100_000), (5, 8, 100_000), (20, 64, 0)])
def test_ranks(values, monkeypatch, small, buckets, broadcast):
    for name, x in (("SMALL", small), ("BUCKETS", buckets), ("BROADCAST_ROWS", broadcast)):
        monkeypatch.setattr(selection, name, x)
    for p in (0.0, 0.5, 0.9, 1.0):
        got = {r.g: r.q for r in selection.nearest_rank(values, "g", "v", p).collect()}
        want = {g: v[min(len(v) - 1, int(len(v) * p))] for g, v in groups().items()}
        assert {g: repr(v) for g, v in got.items()} == {g: repr(v) for g, v in want.items()}


def test_medians(values, monkeypatch):
    monkeypatch.setattr(selection, "SMALL", 50)
    got = {r.g: r.median for r in selection.median(values.filter("g <> 'ends' or g is null"), "g", "v").collect()}
    assert got == {g: statistics.median(v) for g, v in groups().items() if g != "ends"}
    got = {r.g: r.median for r in selection.upper_median(values, "g", "v").collect()}
    assert got == {g: v[len(v) // 2] for g, v in groups().items()}


def test_whole_numbers_stay_whole_and_empty(spark, values):
    few = spark.createDataFrame([("a", k * 10**12) for k in range(101)], "g string, v long")
    assert [tuple(r) for r in selection.nearest_rank(few, "g", "v", 0.5).collect()] == [("a", 50 * 10**12)]
    assert selection.nearest_rank(values.limit(0), "g", "v", 0.5).count() == 0
