"""k-means over tasks against the same rounds written plainly, in one task and in many."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsake.operators import themes

SCHEMA = "scope long, key long, vec array<float>"
BIG = 9_000_000_000_000_000_000


def data():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 5))
    x = centres[rng.integers(6, size=900)] + 0.3 * rng.normal(size=(900, 5))
    rows = [(BIG + 1 if k % 3 else k % 7, BIG + k, v.tolist()) for k, v in enumerate(x)]
    rows += [(50, k, [1.0, 0.0, 0.0, 0.0, 0.0]) for k in range(40)]  # all equal
    rows += [(51, 7, [1.0, 2.0, 0.0, 0.0, 0.0])] * 12 + [(51, None, [0.0, 2.0, 1.0, 0.0, 0.0])] * 3  # repeats
    rows += [(None, k, v.tolist()) for k, v in enumerate(x[:30])] + [(52, 1, [3.0, 0.0, 0.0, 0.0, 1.0])]
    odd = [None, [], [0.0] * 5, [1.0, None, 0.0, 0.0, 0.0], [float("nan")] * 5, [float("inf")] * 5, [1.0, 2.0]]
    return rows, [(50, 900 + k, v) for k, v in enumerate(odd)]


def plain(rows, hashes, most, rounds):
    """Lloyd's rounds a row at a time, from starts drawn by the same race."""
    x = [[c / math.sqrt(sum(float(np.float32(d)) ** 2 for d in v)) for c in map(float, map(np.float32, v))] for v in rows]
    cos = lambda a, b: round(sum(p * q for p, q in zip(a, b)), 12)
    n = len(x)
    k = max(1, min(most, round(math.sqrt(n / 3)), n // 2))
    centres = []
    for turn in range(k):
        race = []
        for v, h in zip(x, hashes):
            z = (h + 0x9E3779B97F4A7C15 * (turn + 1)) % 2**64
            z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
            z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
            u = -math.log((((z ^ z >> 31) >> 11) + 0.5) / 2**53)
            w = max(1 - max(cos(v, c) for c in centres), 0) ** 2 if centres else 1.0
            race.append((w <= 0, u / w if w > 0 else u, h, v))
        centres.append(min(race)[3])
    nearest = lambda v: max(range(k), key=lambda j: (cos(v, centres[j]), -j))
    label = None
    for _ in range(rounds):
        new = [nearest(v) for v in x]
        if new == label:
            break
        label = new
        for j in range(k):
            mine = [v for v, t in zip(x, label) if t == j]
            s = [sum(c) for c in zip(*mine)] if mine else [0.0] * 5
            size = math.sqrt(sum(c * c for c in s))
            if size > 0:
                centres[j] = [c / size for c in s]
    return label


def clustered(df, **kw):
    return sorted(((r.scope, r.key, r.theme) for r in themes.theme_clusters(df, "scope", "key", "vec", **kw).collect()), key=str)


@pytest.fixture(scope="module")
def table(spark):
    rows, odd = data()
    return spark.createDataFrame(rows + odd, SCHEMA).repartition(5).cache()


def test_equals_plain_rounds(spark, table):
    rows, _ = data()
    hashed = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i long, {SCHEMA}").select("i", F.xxhash64("key", F.lit(0)).alias("h"))
    h = dict(map(tuple, hashed.collect()))
    want = []
    for scope in {r[0] for r in rows}:
        at = [i for i, r in enumerate(rows) if r[0] == scope]
        label = plain([rows[i][2] for i in at], [h[i] for i in at], 8, 30)
        want += [(scope, rows[i][1], t) for i, t in zip(at, label)]
    assert clustered(table) == sorted(want, key=str)


def test_tasks_change_nothing(table, monkeypatch):
    one = clustered(table)
    monkeypatch.setattr(themes, "BLOCK", 17)
    assert clustered(table.repartition(3), whole=0) == one
    assert clustered(table.repartition(9), whole=100) == one


def test_a_large_scope_fills_many_tasks(spark, table, monkeypatch):
    monkeypatch.setattr(themes, "BLOCK", 50)
    rows = table.filter(F.col("scope") == BIG + 1).select(F.lit(1).cast("long").alias("g"), "key", F.xxhash64("key").alias("h"), F.col("vec").cast("array<double>").alias("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would share one
    try:
        blocks = themes._blocks(rows, 5).select(F.spark_partition_id().alias("p"), F.size("keys").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(b.n for b in blocks) == rows.count() and max(b.n for b in blocks) <= 50 and len({b.p for b in blocks}) > 2


def test_empty(spark):
    assert clustered(spark.createDataFrame([], SCHEMA)) == []
    assert clustered(spark.createDataFrame([], SCHEMA), whole=0) == []


def walked(rows, least):
    """The clusters of facts (entity, id, said_on, vec), one after another."""
    out, scopes = [], {}
    for entity, key, day, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2] is not None, r[2] or 0, r[1])):
        cents, made = scopes.setdefault(entity, ({}, [0]))
        sound = v is not None and len(v) == 5 and all(c is not None and math.isfinite(c) for c in v) and any(v)
        best = None
        if sound:
            size = math.sqrt(sum(float(np.float32(c)) ** 2 for c in v))
            v = [float(np.float32(c)) / size for c in v]
            near = {k: round(sum(a * b for a, b in zip(c, v)) / math.sqrt(sum(a * a for a in c)), 12) for k, c in cents.items() if any(c)}
            best = max(near, key=lambda k: (near[k], k)) if near and max(near.values()) >= least else None
        if best is None:
            best = made[0]
            made[0] += 1
            if sound:
                cents[best] = v
        elif sound:
            cents[best] = [a + b for a, b in zip(cents[best], v)]
        out.append((entity, key, best))
    return sorted(out, key=str)


@pytest.mark.parametrize("least,chunk", [(0.72, 20_000), (0.72, 100), (0.95, 37), (-0.2, 100)])
def test_dated_clusters_are_the_walk(spark, least, chunk):
    rows, odd = data()
    facts = [(s, k, None if k % 11 == 0 else k % 30, v) for s, k, v in (*[r for r in rows if r[1] is not None and r[0] != 51], *odd)]
    df = spark.createDataFrame(facts, "entity long, id long, said_on int, vec array<float>").repartition(5)
    got = themes.dated_clusters(df, least, chunk).collect()
    assert sorted(((r.entity, r.id, r.cluster) for r in got), key=str) == walked(facts, least)


def test_dated_clusters_of_nothing(spark):
    assert themes.dated_clusters(spark.createDataFrame([], "entity long, id long, said_on int, vec array<float>")).collect() == []
