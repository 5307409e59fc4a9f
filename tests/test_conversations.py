"""Reply trees and labels deeper than any given table."""

from pyspark.sql import functions as F

from keepsake.operators import conversations as cv


def test_deep_replies(spark):
    """A chain of 250, a branch off its end, a cycle with a message under it, and a head alone."""
    rows = [(1, k, k - 1 if k > 1 else None, k) for k in range(1, 251)] + [(1, 251, 249, 1), (1, 900, None, 0)]
    rows += [(2, 3001, 3002, 1), (2, 3002, 3001, 2), (2, 3003, 3002, 3), (2, 3004, 999, 4), (2, 3005, 3004, 5)]
    df = spark.createDataFrame(rows, "thread_id long, msg_id long, parent_id long, ts long")
    parent = {m: p for _, m, p, _ in rows}
    ts = {m: t for _, m, _, t in rows}
    want = {}
    for m in set(parent) - {3001, 3002, 3003}:
        path = [m]
        while parent[path[0]] in parent:
            path.insert(0, parent[path[0]])
        want[m] = (len(path) - 1, [(ts[x], x) for x in path])
    found = cv.reply_paths(df).collect()
    assert len(found) == len(want) and {r["msg_id"]: (r["depth"], [tuple(x) for x in r["path"]]) for r in found} == want
    # the earlier reply to 249 is 251, which ends the chain
    assert {(r["head"], r["length"]) for r in cv.own_reply_chains(df, F.lit(True), 1).collect()} == {(1, 250), (900, 1), (3004, 2)}


def test_names_meet_by_level_and_not_by_their_first_word(spark):
    """Against all pairs, on few words and repeated subjects; and 20,000 names of one first word in one scope, whose pairs are 400 million."""
    import random

    from keepsake.operators import identity

    rng = random.Random(5)
    name = lambda: " ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 4)))
    subjects = [(rng.randrange(150), rng.randrange(3), name()) for _ in range(200)] + [(900, None, "a"), (901, 1, "")]
    people = [(rng.randrange(3), rng.randrange(40), name()) for _ in range(50)] + [(None, 1, "a"), (1, None, "g f e d")]
    hits = {}
    for i, scope, n in subjects:
        for at, account, m in people:
            if scope is None or scope != at or not n or not m:
                continue
            a, b = set(n.split()), set(m.split())
            level = 1 if n == m else 2 if a == b else 3 if a <= b else 4 if n.split()[0] == m.split()[0] else None
            if level:
                hits.setdefault(i, {}).setdefault(level, set()).add(account)
    want = {i: next(iter(h[min(h)])) for i, h in hits.items() if len(h[min(h)]) == 1}
    got = identity.match_levels(spark.createDataFrame(subjects, "subject_id long, scope long, name string"), spark.createDataFrame(people, "scope long, account_id long, name string"))
    assert {r.subject_id: r.account_id for r in got.collect()} == want and len(want) > 20

    many = spark.range(20_000).select(F.lit(1).alias("scope"), F.col("id"), F.concat(F.lit("customer "), F.col("id").cast("string")).alias("name"))
    plan = identity.match_levels(many.select(F.col("id").alias("subject_id"), "scope", "name"), many.select("scope", F.col("id").alias("account_id"), "name"))
    assert plan.filter("subject_id = account_id").count() == 20_000
