"""The stored adjacency against sets, with a hub over many blocks."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from keepsake.operators import adjacency

SCHEMA = "source string, target string, weight long"


def data():
    rows = [("hub", f"n{k}", k) for k in range(300)] + [(f"n{k}", f"n{(k * 7 + 1) % 300}", 1) for k in range(0, 300, 5)]
    rows += [("n1", "hub", 5), ("loop", "loop", 2), ("a", "b", 1), ("b", "c", None), ("c", "d", 1), (None, "a", 1), ("a", None, 1)]
    return rows


def sets():
    out = defaultdict(lambda: defaultdict(int))
    for a, b, w in data():
        if a is not None and b is not None:
            for x, y in {(a, b), (b, a)}:
                out[x][y] += w or 0
    return out


@pytest.fixture(scope="module")
def graph(spark):
    return adjacency.build(spark.createDataFrame(data(), SCHEMA).repartition(4), block=16, folders=5)


def test_neighbours(spark, graph):
    want = {(a, b, w) for a, n in sets().items() for b, w in n.items()}
    asked = spark.createDataFrame([(n,) for n in (*sets(), "nobody", None)], "node string")
    assert sorted(map(tuple, graph.neighbours(asked).collect())) == sorted(want)
    assert {(r.id, r.weight) for r in graph.of("hub", "hub").collect()} == {(b, w) for b, w in sets()["hub"].items()}


def test_a_hub_is_in_blocks(graph):
    sizes = [len(r.neighbours) for r in graph.blocks.filter("node = 'hub'").collect()]
    assert len(sizes) > 10 and sum(sizes) == 300 and max(sizes) < 48


def test_few_nodes_open_their_folders_only(spark, graph):
    _, blocks = graph._opened(spark.createDataFrame([("a",)], "node string"))
    assert blocks.select("folder").distinct().count() == 1 < graph.blocks.select("folder").distinct().count()
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan or "PartitionFilters: [folder" in plan


@pytest.mark.parametrize("hops,few", [(0, 1000), (1, 1000), (2, 1000), (3, 3), (9, 1000)])
def test_expansion_is_by_fewest_steps(spark, graph, monkeypatch, hops, few):
    monkeypatch.setattr(adjacency, "FEW", few)
    seeds = [("one", "a"), ("two", "n3"), ("two", "d"), (None, "loop"), ("far", "nobody"), ("none", None), ("one", "a")]
    want, near = set(), sets()
    for s in {t for t, n in seeds if n}:
        level, seen = {n for t, n in seeds if t == s and n}, {}
        for hop in range(hops + 1):
            seen |= {n: hop for n in level}
            level = {m for n in level for m in (near[n] if n in near else ())} - set(seen)
        want |= {(s, n, h) for n, h in seen.items()}
    got = graph.expanded(spark.createDataFrame(seeds, "seed string, node string"), hops).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty(spark):
    none = adjacency.build(spark.createDataFrame([], SCHEMA))
    assert none.of("a").collect() == [] and none.expanded(spark.createDataFrame([("s", "a")], "seed string, node string"), 2).count() == 1


def test_pairs_met_are_grouped_once(spark, monkeypatch):
    """What a step meets is dealt by pair once, with the levels before; it was shuffled for distinct pairs and again for each level left out."""
    graph = adjacency.build(spark.createDataFrame([(f"a{k}", f"b{k % 5}", 1) for k in range(40)], "source string, target string, weight long"))
    plans, kept = [], adjacency.kept
    monkeypatch.setattr(adjacency, "kept", lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), kept(df, name))[1])
    got = graph.expanded(spark.createDataFrame([("s", "a0"), (None, "a1")], "seed string, node string"), 3)
    assert len(plans) == 4 and not any("LeftAnti" in p for p in plans)
    assert sorted((str(r.seed), r.hop) for r in got.collect()) == sorted([("s", 0), ("s", 1), *[("s", 2)] * 7, ("None", 0), ("None", 1), *[("None", 2)] * 7])


@pytest.mark.parametrize("listed,at_one", [(None, None), (7, None), (None, 9), (5, 11)])
def test_two_steps_of_all_members(spark, listed, at_one):
    """Against sets: a group of many, a member of many, rows that repeat, members alone, nulls on either side; lists and counts in parts too."""
    rows = [(k, 1) for k in range(60)] + [(5, g) for g in range(40)] + [(k % 17, k % 23) for k in range(90)] + [(99, 500), (98, None), (5, None), (5, None), (None, 1), (None, 2)]
    got = adjacency.two_steps(spark.createDataFrame(rows, "member long, grp long").repartition(4), listed, at_one).collect()
    near, far = defaultdict(set), {}
    for m, g in rows:
        near[m].add(g)
    for m, groups in near.items():
        far[m] = {n for n, g in rows if g is not None and g in groups and n not in (None, m)} if m is not None else set()
    assert sorted(map(tuple, got), key=str) == sorted(((m, len(near[m]), len(far[m])) for m in near), key=str)
    assert adjacency.two_steps(spark.createDataFrame([], "member long, grp long")).collect() == []


def test_no_pair_of_parts_is_shuffled(spark, sf):
    """Lists of an order's parts go to each part; before, each pair of parts was a row of strings that was shuffled, written and shuffled again."""
    from keepsake.plans import registry

    df = registry.queries()["gr08_two_hop_nets"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "members" in plan and [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "other" in line] == []
    assert df.agg(F.sum("near")).first()[0] == spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey", "l_orderkey").distinct().count()
