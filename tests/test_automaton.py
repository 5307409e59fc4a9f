"""Patterns found by the automaton against a search of each in each text."""

import random

import pytest
from pyspark.sql import functions as F

from keepsake.operators import identity, retrieval
from keepsake.operators.automaton import Automaton, occurring


def inside(p, t):
    return any(t[k : k + len(p)] == p for k in range(len(t) - len(p) + 1))


@pytest.mark.parametrize("states", [10**6, 40])
def test_is_brute_force(spark, states):
    rng = random.Random(5)
    texts = [[rng.choice("abcdef") for _ in range(rng.randint(0, 40))] for _ in range(80)] + [["a"] * 500]
    patterns = sorted({tuple(rng.choice("abcdeg") for _ in range(rng.randint(1, 5))) for _ in range(60)} | {("a",) * 7, ("a",) * 501})
    rows = spark.createDataFrame([*enumerate(texts), (900, None), (None, ["a", "a"])], "id long, tokens array<string>").repartition(3)
    got = occurring(rows, spark.createDataFrame([(" ".join(p), list(p)) for p in patterns] + [("", [])], "pattern string, tokens array<string>"), states).collect()
    want = {(k, " ".join(p)) for k, t in [*enumerate(texts), (None, ["a", "a"])] for p in patterns if inside(list(p), t)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_a_hundred_thousand_patterns(spark):
    """Common first words and long ones; the texts are not shuffled."""
    patterns = spark.range(100_000).select(F.concat(F.lit("the w"), F.col("id") % 1000, F.lit(" x"), F.col("id")).alias("keyword"))
    texts = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("And THE, w"), F.col("id") % 1000, F.lit("-x"), F.col("id") * 3, F.lit(". the w1 x1")).alias("text"))
    found = retrieval.containing(patterns, texts)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.doc, r.keyword) for r in found.collect()}
    want = {(k, "the w1 x1") for k in range(300)} | {(k, f"the w{k} x{3 * k}") for k in range(300) if (3 * k) % 1000 == k}
    assert got == want


def test_several_patterns_of_the_same_words():
    ids, row = Automaton([["a", "b"], ["a"], ["a", "b"], ["b"]]).ids, [0, 0, 1]
    import numpy as np
    import pyarrow as pa

    a = Automaton([["a", "b"], ["a"], ["a", "b"], ["b"]])
    place, pattern = a.run(ids(pa.array(["a", "b", "a"])), np.array(row))
    assert sorted(zip(place.tolist(), pattern.tolist())) == [(0, 0), (0, 1), (0, 2), (1, 3), (2, 1)]


def test_names(spark):
    texts = spark.createDataFrame([(1, "Ann Lee, ann  lee; O'Neil and joann"), (2, None), (3, "ANN")], "id long, text string")
    names = spark.createDataFrame([("Ann", 5), ("ann lee", 4), ("Lee", 1), ("o'neil", 3)], "name string, size long")
    assert sorted(map(tuple, identity.mentioned(texts, names).collect())) == [(1, "Ann"), (1, "Lee"), (1, "ann lee"), (1, "o'neil"), (3, "ANN".title())]
    assert [tuple(r) for r in identity.mentioned(texts, names, each=1).orderBy("id").collect()] == [(1, "Ann"), (3, "Ann")]
    assert identity.mentioned(texts, names.limit(0)).count() == 0
