"""The metric index against all pairs: same rows, few of them compared where vectors cluster, hot groups in chunks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsake.functions.vectors import cosine
from keepsake.operators import similarity
from keepsake.operators.similarity import Index, candidates, cosine_join, dot_join, nearest_join

SCHEMA = "id long, entity string, vec array<float>"


def clustered(n, clusters=40, width=32, spread=0.02, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    x = centres[rng.integers(clusters, size=n)] + spread * rng.normal(size=(n, width)) * np.sqrt(width)
    return [(k, "hot" if k % 3 == 0 else f"e{k % 7}", (v * rng.uniform(0.5, 2)).tolist()) for k, v in enumerate(x)]


@pytest.fixture(scope="module")
def rows(spark):
    odd = [(9001, "hot", None), (9002, "hot", [0.0] * 32), (9003, "hot", [1.0, None] + [0.0] * 30), (9004, None, [1.0] * 32), (9005, "hot", [1.0, 2.0]), (9006, "hot", [2.0, 4.0]), (9007, "hot", [float("nan")] * 32)]
    return spark.createDataFrame([*clustered(900), *odd], SCHEMA).repartition(5).cache()


def brute(left, right, least, by):
    on = F.lit(True) if by is None else F.col("l.entity") == F.col("r.entity")
    same = F.size("l.vec") == F.size("r.vec")
    pairs = left.alias("l").join(right.alias("r"), on & same).filter(cosine(F.col("l.vec"), F.col("r.vec")) >= least).filter(~F.exists("l.vec", F.isnan) & ~F.exists("r.vec", F.isnan))
    return sorted(map(tuple, pairs.select("l.id", "r.id").collect()))


@pytest.mark.parametrize("least,by", [(0.9, "entity"), (0.9, None), (0.3, "entity"), (-0.5, "entity"), (0.999, None)])
def test_cosine_join_is_all_pairs(rows, least, by):
    got = cosine_join(rows if by else rows.drop("entity"), rows if by else rows.drop("entity"), least, by)
    assert sorted(map(tuple, got.select("l_id", "r_id").collect())) == brute(rows, rows, least, by)


def test_chunks_and_shuffled_blocks_change_nothing(rows, monkeypatch):
    monkeypatch.setattr(similarity, "CHUNK", 5)
    monkeypatch.setattr(similarity, "BLOCKS", 0)
    got = cosine_join(rows, rows, 0.9, "entity", extra=lambda p: p.l_id < p.r_id)
    assert sorted(map(tuple, got.select("l_id", "r_id").collect())) == [p for p in brute(rows, rows, 0.9, "entity") if p[0] < p[1]]


def test_few_pairs_are_compared_on_clusters(spark):
    rows = spark.createDataFrame(clustered(3000, spread=0.01, seed=3), SCHEMA).cache()
    every = rows.groupBy("entity").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
    met = candidates(rows, rows, 0.86, "entity").count()
    assert met < 0.1 * every and met >= cosine_join(rows, rows, 0.86, "entity").count() > 3000


def test_a_hot_group_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "CHUNK", 50)
    rows = spark.createDataFrame([(k, "one", v) for k, _, v in clustered(2000, seed=4)], SCHEMA)
    keys = Index(rows, "entity").chunked().groupBy("_g", "_block", "_chunk").count().agg(F.count("*"), F.max("count")).first()
    assert keys[0] >= 40 and keys[1] <= 120


def test_dot_join(rows):
    short = rows.filter("id < 200")
    got = sorted(map(tuple, dot_join(short, short, 20.0, "entity").select("l_id", "r_id").collect()))
    x = {r.id: (r.entity, np.array(r.vec, np.float64)) for r in short.collect()}
    assert got == sorted((a, b) for a in x for b in x if x[a][0] == x[b][0] and x[a][1] @ x[b][1] >= 20.0) and got


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_join_is_brute_force(rows, k):
    left = rows.filter("id % 9 = 0 and id < 900")
    right = rows.filter("id % 2 = 1 and id < 900")
    got = {}
    for r in nearest_join(left, right, k, "id", "entity").orderBy("l_id", "k").collect():
        got.setdefault(r.l_id, []).append(r.r_id)
    x = {r.id: (r.entity, np.array(r.vec, np.float64)) for r in left.unionByName(right).collect()}
    own, other = [r.id for r in left.collect()], [r.id for r in right.collect()]
    cos = lambda a, b: round(float(x[a][1] @ x[b][1] / np.linalg.norm(x[a][1]) / np.linalg.norm(x[b][1])), 9)
    want = {a: sorted((b for b in other if x[a][0] == x[b][0]), key=lambda b: (-cos(a, b), b))[:k] for a in own}
    assert got == {a: b for a, b in want.items() if b}


def test_nearest_of_many_chunks_with_ties(spark, monkeypatch):
    """Copies tie and go by id, over chunks too; what leaves a product is k rows or little more for each row asked, not all pairs (before, each pair was compared as a row)."""
    monkeypatch.setattr(similarity, "DEALT", 60)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(200, 16)), np.repeat(rng.normal(size=(1, 16)), 100, axis=0)])
    rows = spark.createDataFrame([(k, "one", v.tolist()) for k, v in enumerate(x)], SCHEMA).repartition(3).cache()
    met, products = [], similarity._products
    monkeypatch.setattr(similarity, "_products", lambda *a: (met.append(products(*a)), met[-1])[1])
    got = sorted((r.l_id, r.k, r.r_id) for r in nearest_join(rows, rows, 3, "id", "entity").collect())
    f = x.astype(np.float32).astype(np.float64)
    cos = np.round(f @ f.T / np.outer(*[np.linalg.norm(f, axis=1)] * 2), 9)
    assert got == sorted((a, n + 1, int(b)) for a in range(300) for n, b in enumerate(np.lexsort((np.arange(300), -cos[a]))[:3]))
    assert met[0].count() <= 3 * 300 * 6


def test_empty(rows):
    none = rows.limit(0)
    assert cosine_join(none, none, 0.5, "entity").count() == 0 and cosine_join(rows, none, 0.5, "entity").count() == 0 and cosine_join(none, rows, 0.5, None).count() == 0
    assert nearest_join(rows.filter("id < 9"), none, 2, "id", "entity").count() == 0


def test_pairs_are_not_shuffled(spark):
    """Themes meet once under their first two common topics, sets are compared once for all rows that have them: no shuffle stands over the join."""
    from keepsake.operators import graph, identity, tables

    rng = np.random.default_rng(8)
    data = [(k, int(rng.integers(5)), [*rng.choice(list("abcdefgh"), int(rng.integers(0, 6))).tolist(), "all", None]) for k in range(120)]
    themes = spark.createDataFrame(data, "theme long, account long, topics array<string>")
    for least in (1, 2, 3):
        df = graph.shared_themes(themes, ("all",), least)
        common = {(x[0], y[0]): sorted(set(x[2]) & set(y[2]) - {"all", None}) for x in data for y in data if x[0] < y[0] and x[1] != y[1]}
        assert sorted((r.a, r.b, r.topics) for r in df.collect()) == sorted((a, b, t) for (a, b), t in common.items() if len(t) >= least)
    plan = graph.shared_themes(themes, ("all",))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < (plan.index("Aggregate") if "Aggregate" in plan else len(plan)) and "collect_set" not in plan

    sets = [(k % 3, k, sorted(set(rng.choice(list("abcdef"), 3).tolist()))) for k in range(90)]
    got = identity.members_inside(spark.createDataFrame([(g, k, s[:2]) for g, k, s in sets], "brand int, a long, inner array<string>"), spark.createDataFrame(sets, "brand int, b long, outer array<string>"))
    assert sorted(map(tuple, got.collect())) == sorted((g, a, b) for g, a, s in sets for h, b, t in sets if g == h and set(s[:2]) <= set(t))

    rows = spark.range(500).select((F.col("id") % 3).alias("g"), "id")
    met = tables.met_under(rows, rows, ["g"], chunk=20)
    assert met.count() == sum((500 // 3 + (500 % 3 > k)) ** 2 for k in range(3)) == met.distinct().count()


def test_pairs_leave_in_order_of_their_key(spark):
    """Rows of left that meet the same rows of right follow each other in a part; they stood as they came, and files of pairs were thirteen times as large."""
    from keepsake.operators import tables

    rows = spark.range(900).select((F.col("id") % 40).alias("g"), "id").repartition(5)
    met = tables.met_under(rows, rows, ["g"], chunk=8).rdd.glom().collect()
    assert sum(map(len, met)) == sum((900 // 40 + (900 % 40 > k)) ** 2 for k in range(40))
    for part in met:
        keys = [r.g for r in part]
        assert sum(x != y for x, y in zip(keys, keys[1:])) == max(len(set(keys)) - 1, 0)


def test_themes_of_every_customer_are_compared(spark, tmp_path):
    """jn27 took only customers whose key a number divides, in its SQL too."""
    from keepsake.plans import registry

    spark.range(40).select(F.col("id").alias("c_custkey"), (F.col("id") % 4).cast("int").alias("c_nationkey"), F.lit("m").alias("c_mktsegment")).write.parquet(f"{tmp_path}/customer.parquet")
    got = registry.queries()["jn27_shared_themes"](spark, str(tmp_path)).collect()
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 40) if a % 9 == b % 9 and a % 4 != b % 4]
    assert sorted((r.a, r.b) for r in got) == pairs and any(a % 4 and b % 4 for a, b in pairs)


def test_near_ids_meet_in_stretches(spark, tmp_path):
    """3,000 customers of one nation and segment: jn20 joins by stretches of ids too, not all pairs of them."""
    from keepsake.plans import registry

    spark.range(3000).select(F.col("id").alias("c_custkey"), F.lit(1).alias("c_nationkey"), F.lit("m").alias("c_mktsegment")).write.parquet(f"{tmp_path}/customer.parquet")
    df = registry.queries()["jn20_rejected_pairs"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [(a, b) for a in range(3000) for b in range(a + 1, min(a + 120, 3000)) if (a + b) % 3]
    assert "(cell#" in df._jdf.queryExecution().optimizedPlan().toString()


def test_dealt_products_are_all_pairs(rows, monkeypatch):
    """Groups over many chunks of both sides; the pairs come from products of matrices, with no join of rows to be compared one by one."""
    monkeypatch.setattr(similarity, "DEALT", 37)
    got = cosine_join(rows, rows, 0.3, "entity")
    assert sorted(map(tuple, got.select("l_id", "r_id").collect())) == brute(rows, rows, 0.3, "entity")
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("share,carried", [(0.5, 64), (0.5, 3), (0.34, 0), (1.0, 64)])
def test_sets_mostly_shared(spark, monkeypatch, share, carried):
    """Against all pairs, with sets carried and sets counted; carried pairs are settled where they meet, with no aggregate by pair."""
    from keepsake.operators import graph

    monkeypatch.setattr(graph, "CARRIED", carried)
    rng = np.random.default_rng(4)
    data = [(k, int(x)) for k in range(60) for x in rng.integers(0, 30, int(rng.integers(1, 8)))] + [(None, 1), (3, None)]
    sets = {}
    for g, x in data:
        if g is not None and x is not None:
            sets.setdefault(g, set()).add(x)
    df = graph.mostly_shared(spark.createDataFrame(data, "g long, x long"), share)
    want = sorted((a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a != b and len(sets[a] & sets[b]) >= share * len(sets[a]) and sets[a] & sets[b])
    assert sorted(map(tuple, df.collect())) == want
    if carried == 64:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [a#" not in plan and "Aggregate" not in plan[: plan.index("Join Inner")]
