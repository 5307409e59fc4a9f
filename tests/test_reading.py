"""Names of themes against a walk in Python, readers on deep and odd input, statements that are refused."""

import io
import json
import math
import zipfile
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from keepsake.operators import memory, tables
from keepsake.plans import registry
from keepsake.plans.reading import theme_topics
from keepsake.sources import exports, views


def test_theme_names(spark, sf):
    got = {(r["scope"], r["theme"]): r["names"] for r in memory.theme_names(theme_topics(spark, sf)).collect()}
    items = defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
    for r in theme_topics(spark, sf).collect():
        items[r["scope"]][r["theme"]][r["item"]].add(r["topic"])
    want = {}
    for scope, themes in items.items():
        total, used = sum(map(len, themes.values())), set()
        for theme, own in sorted(themes.items(), key=lambda x: (-len(x[1]), x[0])):
            n = len(own)
            if n < 2 or n < 0.02 * total:
                continue
            scores = {}
            for t in set().union(*own.values()):
                c = sum(t in x for x in own.values())
                every = sum(t in x for o in themes.values() for x in o.values())
                fin, fout = c / n, (every - c) / (total - n) if total > n else 0.0
                if c >= min(2, n):
                    scores[t] = round(fin * math.log((fin + 0.01) / (fout + 0.01)), 9)
            best = [t for t in sorted(scores, key=lambda t: (-scores[t], t)) if scores[t] > 0 and t not in used][:3]
            used.update(best)
            if best:
                want[scope, theme] = best
    assert got == want and len(want) > 5


def test_deep_comment_trees(spark):
    """A chain of 60 comments with a branch at each, an empty one, one without replies."""
    node = {"id": "end", "author": "z", "body": "b"}
    for k in range(60):
        node = {"id": f"n{k}", "author": "a", "body": str(k), "replies": [node, {"id": f"s{k}"}, {}]}
    trees = spark.createDataFrame([(1, json.dumps(node)), (2, "{}"), (3, json.dumps({"id": "x"}))], "thread int, tree string")
    rows = {r["id"]: r for r in exports.flattened_comments(trees).collect()}
    assert len(rows) == 122 and rows["end"]["depth"] == 60 and rows["end"]["parent"] == "n0" and rows["s59"]["parent"] == "n59" and rows["x"]["parent"] is None


def test_zip_files_at_any_depth(spark, tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("messages/inbox/a/message_1.json", '{"thread_path": "inbox/a", "title": "T", "messages": [{"sender_name": "x", "timestamp_ms": 1999, "content": "b"}, {"sender_name": "y", "timestamp_ms": 999, "content": "a"}]}')
        z.writestr("other.txt", "no")
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "a.zip").write_bytes(raw.getvalue())
    members = exports.zip_members(exports.zip_files(spark, str(tmp_path)), r"message_\d+\.json$")
    got = exports.chats(members.selectExpr("cast(content as string) as value")).orderBy("place").collect()
    assert [(r["content"], r["ts"], r["place"], r["previous"]) for r in got] == [("a", 0, 1, None), ("b", 1, 2, 1)]


def test_reimport_keeps_and_adds(spark):
    """An export of five messages, the same again, then one with two more of which one is a repeat: 5, 5, 7, 7; nothing stored goes."""
    columns = "ts long, text string"
    first = [(1, "a"), (2, "b"), (2, "b"), (3, "c"), (4, "d")]
    stored = spark.createDataFrame(first, columns)
    counts = []
    table = stored.limit(0)
    later = [(2, "b"), (2, "b"), (2, "b"), (5, "e"), (4, "d")]  # without what the export no longer has
    for rows in (first, first, later, later):
        table = tables.reimported(table, spark.createDataFrame(rows, columns), ["ts", "text"], ["ts", "text"])
        counts.append(table.count())
    assert counts == [5, 5, 7, 7]
    assert table.filter("text = 'a'").count() == 1


def test_copies_that_differ_are_refused(spark):
    df = spark.createDataFrame([("a", None, "x", 1), ("a", None, "y", 2)], "id string, parent string, body string, place int")
    with pytest.raises(Exception, match="copies differ"):
        tables.compacted(df, "id", "place", ["parent", "body"]).collect()


def test_statements(spark, sf):
    views.register(spark, sf)
    assert views.select(spark, "SELECT count(*) AS n FROM messages", limit=1, deadline=300.0).first()["n"] == registry.queries()["sc04_wrapped_json"](spark, sf).first()["posts"]
    for bad in ("DROP VIEW messages", "SELECT 1; SELECT 2", "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x"):
        with pytest.raises(ValueError):
            views.select(spark, bad)


def test_ordered(spark):
    rows = [(k * 7919 % 500, k) for k in range(2000)]
    got = tables.ordered(spark.createDataFrame(rows, "a long, b long").repartition(5), ["a", "b"], "k").collect()
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["k"])] == sorted(rows) and sorted(r["k"] for r in got) == list(range(2000))


def test_times_in_ids(spark):
    """Ids of 19 digits too; what is no number, too large for one or from before such ids has no time."""
    from keepsake.functions import times

    ids = ["1750000000000000000", "9223372036854775807", "99999999999999", "9999999999999999999", "123", "12a", ""]
    got = [r["t"] for r in spark.createDataFrame([(k, i) for k, i in enumerate(ids)], "k int, i string").select("k", times.id_time(F.col("i")).alias("t")).orderBy("k").collect()]
    want = [((int(i) >> 22) + times.EPOCH_MS) // 1000 for i in ids[:3]]
    assert got == [*want, None, None, None, None]


def test_times_in_ids_past_64_bits(spark, tmp_path):
    """pf02's products leave 64 bits from event 54,255 on; the rows then have the exact time."""
    from keepsake.functions import times
    from keepsake.plans import registry

    ids = [-1, 0, 1, 54_254, 54_255, 99_999, 6_000_000, None]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: r["ts"] for r in registry.queries()["pf02_id_time"](spark, str(tmp_path)).collect()}
    assert got == {i: ((i * 170_000_000_000_000 >> 22) + times.EPOCH_MS) // 1000 if i and i > 0 else None for i in ids}
