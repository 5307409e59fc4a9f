"""Writes, re-imports, incremental work and streams."""

from __future__ import annotations

import contextlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import times
from ..operators import identity
from ..operators import tables as tb
from ..sources.archive import CHATS_SQL, EVENTS_SQL, chat_messages, event_messages, read
from ..sources.shared import fresh, kept
from ..streaming import feeds, sessions
from .registry import query
from .sequences import SESSIONS_SQL, units


@query("sk06_purged", "SELECT p_partkey, p_type FROM part WHERE NOT starts_with(p_type, 'EC')")
def sk06(spark, d):
    return tb.purged(read(spark, d, "part", "p_partkey", "p_type"), "p_type", "EC")


@query("sk08_stable_ids", "WITH k AS (SELECT c_nationkey AS n, c_mktsegment AS m, min(c_custkey) + 1 AS id FROM customer WHERE c_custkey % 7 = 0 GROUP BY 1, 2), f AS (SELECT DISTINCT c_nationkey AS n, c_mktsegment AS m FROM customer EXCEPT SELECT n, m FROM k) SELECT n, m, id FROM k UNION ALL SELECT n, m, row_number() OVER (ORDER BY n, m) + (SELECT max(id) FROM k) FROM f")
def sk08(spark, d):
    rows = read(spark, d, "customer").select(F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("m"), "c_custkey")
    known = rows.filter("c_custkey % 7 = 0").groupBy("n", "m").agg((F.min("c_custkey") + 1).alias("id"))
    return tb.with_keys(known, rows, ["n", "m"])


@query("sk11_recreated", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def sk11(spark, d):
    """The second writing replaces what the first left."""
    name = "keepsake_" + fresh(spark, "t").rsplit("-", 1)[1]
    tb.recreated(read(spark, d, "customer", "c_custkey"), name)
    return tb.recreated(read(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")), name)


@query("sk17_run_report", "SELECT unnest(['# Run', '- customers: ' || format('{:,}', (SELECT count(*) FROM customer)), '- orders: ' || format('{:,}', (SELECT count(*) FROM orders))]) AS line")
def sk17(spark, d):
    text = tb.report(spark, [("customers", read(spark, d, "customer").count()), ("orders", read(spark, d, "orders").count())])
    return spark.createDataFrame([(x,) for x in text.split("\n")], "line string")


@query("sk18_result_cache", "SELECT user_id AS account_id, max(event_id) AS stamp, CASE WHEN user_id % 3 = 0 THEN 'held' ELSE CAST(count(*) AS VARCHAR) END AS result FROM events GROUP BY 1")
def sk18(spark, d):
    """Every third account's result stands under its present stamp, every third's under an old one."""
    e = read(spark, d, "events").select(F.col("user_id").alias("account_id"), "event_id")
    stamp = e.groupBy("account_id").agg(F.max("event_id").alias("stamp"))
    memo = stamp.filter("account_id % 3 <> 2").select("account_id", (F.col("stamp") - F.col("account_id") % 3).alias("stamp"), F.lit("held").alias("result"))
    counts = lambda keys: e.join(keys, "account_id", "left_semi").groupBy("account_id").agg(F.count("*").cast("string").alias("result"))
    return tb.cached(stamp.select("account_id"), memo, stamp, counts, "account_id")


@query("sk21_compacted", "SELECT event_id AS id, CASE WHEN event_id > 0 THEN event_id // 3 END AS parent, event_type AS body, event_id AS place FROM events")
def sk21(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") > 0, F.floor(F.col("event_id") / 3).cast("long")).alias("parent"), F.col("event_type").alias("body"), F.col("event_id").alias("place"))
    copies = e.filter("id % 4 = 0").withColumn("later", F.explode(F.array(F.lit(1_000_000), F.lit(2_000_000)))).withColumn("place", F.col("place") + F.col("later"))
    return tb.compacted(e.unionByName(copies.drop("later")), "id", "place", ["parent", "body"])


@query("pf16_stale_counts", "SELECT c_custkey AS id FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE n IS NOT NULL AND (c_custkey % 4 = 0 OR c_custkey % 4 = 1)")
def pf16(spark, d):
    """Of four accounts one has no stored count, one an old one."""
    n = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    return tb.stale(n, n.filter("id % 4 <> 0").select("id", (F.col("n") - F.when(F.col("id") % 4 == 1, 1).otherwise(0)).alias("n")), "id")


@query("pf17_not_yet_done", "SELECT o_orderkey AS id FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderkey % 2 = 0)")
def pf17(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    done = o.filter("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, "v3").otherwise("v2").alias("version"))
    return tb.pending(o, done, "id", "v3")


@query("pf29_wanted_sessions", f"WITH {CHATS_SQL}, s AS (SELECT thread_id, sum(len(regexp_extract_all(content, '\\S+'))) AS tokens FROM chats GROUP BY 1) SELECT thread_id, CAST(tokens AS BIGINT) AS tokens FROM s WHERE tokens >= 100 AND thread_id % 3 <> 0")
def pf29(spark, d):
    m = chat_messages(spark, d)
    s = m.groupBy("thread_id").agg(F.sum(F.size(F.regexp_extract_all("content", F.lit(r"\S+"), F.lit(0)))).alias("tokens"))
    done = s.filter("thread_id % 3 = 0").select("thread_id", F.lit("v1").alias("version"))
    return tb.pending(s.filter("tokens >= 100"), done, "thread_id", "v1")


REIMPORT = "SELECT event_type AS body, user_id AS thread FROM events WHERE event_id % 5 <> 0"


@query("jn29_already_stored", "WITH s AS (SELECT user_id AS thread, CAST(floor(epoch(ts)) AS BIGINT) AS sec, lower(event_type) AS t, event_id FROM events) SELECT event_id FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.event_id % 5 <> 0 AND o.thread = s.thread AND o.sec = s.sec AND o.t = s.t)")
def jn29(spark, d):
    """Messages whose second and normalised text no stored one of their thread has."""
    from ..functions import text as tx

    m = event_messages(spark, d).select("thread_id", "ts", F.concat(F.lit(" "), F.upper("author")).alias("text"), "msg_id")
    key = ["thread_id", "ts", "t"]
    m = m.withColumn("t", tx.same_text(F.col("text")))
    return m.join(m.filter("msg_id % 5 <> 0").select(*key).distinct(), key, "left_anti").select(F.col("msg_id").alias("event_id"))


@query("ss05_late_content", "SELECT event_id AS msg_id, event_type AS content, CASE WHEN event_id > 0 THEN event_id // 3 END AS parent_id FROM events")
def ss05(spark, d):
    """Placeholders first, then the real data in two deliveries, through a stream of micro-batches."""
    m = event_messages(spark, d).select("msg_id", F.col("author").alias("content"), "parent_id")
    gaps = m.filter("msg_id % 2 = 0").select("msg_id", F.concat(F.lit(tb.MISSING), F.lit("]")).alias("content"), F.lit(None).cast("long").alias("parent_id"))
    parts = [gaps, m.filter("msg_id % 3 <> 0"), m]
    return feeds.replayed(spark, parts, lambda held, batch: tb.upgraded(held, batch.dropDuplicates(["msg_id"])))


@query("ss06_incremental", "SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1")
def ss06(spark, d):
    """Results held by version and count: only what is stale is made again, and the table is right after."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey")
    now = o.groupBy("id").agg(F.count("*").alias("n"))
    held = o.filter("o_orderkey % 10 <> 0").groupBy("id").agg(F.count("*").alias("n"))
    again = tb.stale(now, held, "id")
    fixed = o.join(again, "id", "left_semi").groupBy("id").agg(F.count("*").alias("n"))
    return tb.upserted(held, fixed, ["id"])


@query("ss07_resumed_stages", f"WITH {EVENTS_SQL} SELECT thread_id, count(*) AS n, count(DISTINCT author) AS authors, 1 AS parsed, 1 AS built, 2 AS indexed FROM msgs GROUP BY 1")
def ss07(spark, d):
    """A run over all messages that fails in its third stage; the next one does only that, from the tables that the first has left."""
    state, tables = fresh(spark, "state"), fresh(spark, "stages")

    def stages(run: int, fails: bool):
        number = lambda name: F.lit(run).cast("int").alias(name)
        at = lambda name: spark.read.parquet(f"{tables}/{name}")

        def parse():
            event_messages(spark, d).select("thread_id", "author", number("parsed")).write.parquet(f"{tables}/parse")

        def build():
            at("parse").groupBy("thread_id", "author", "parsed").agg(F.count("*").alias("n")).select("*", number("built")).write.parquet(f"{tables}/build")

        def index():
            if fails:
                raise RuntimeError("index")
            at("build").groupBy("thread_id", "parsed", "built").agg(F.sum("n").alias("n"), F.count("*").alias("authors")).select("*", number("indexed")).write.parquet(f"{tables}/index")

        return [("parse", parse), ("build", build), ("index", index)]

    with contextlib.suppress(RuntimeError):
        feeds.resumed(spark, state, stages(1, True))
    feeds.resumed(spark, state, stages(2, False))
    return spark.read.parquet(f"{tables}/index").select("thread_id", "n", "authors", "parsed", "built", "indexed")


@query("ss10_stamped_view", "SELECT user_id, count(*) AS n, 'fast' AS view, 'held' AS log FROM events GROUP BY 1 UNION ALL SELECT user_id, count(*), 'slow', 'grown' FROM (SELECT user_id FROM events UNION ALL SELECT user_id FROM events WHERE event_id % 3 = 0) GROUP BY 1")
def ss10(spark, d):
    """The precomputed table is used as long as its stamp (count and largest id) is the log's; once the log has grown it is made anew from the log."""
    e = read(spark, d, "events", "event_id", "user_id")
    last = e.agg(F.max("event_id")).first()[0]
    grown = e.unionByName(e.filter("event_id % 3 = 0").withColumn("event_id", F.col("event_id") + last + 1))
    counts = lambda log: log.groupBy("user_id").agg(F.count("*").alias("n"))
    facts, held = kept(counts(e), "facts"), feeds.stamp(e, "event_id")
    seen = lambda log, name: feeds.fresher(log, "event_id", held, facts.withColumn("view", F.lit("fast")), counts(log).withColumn("view", F.lit("slow"))).withColumn("log", F.lit(name))
    return seen(e, "held").unionByName(seen(grown, "grown"))


@query("ss01_watermark", "SELECT event_type AS author, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def ss01(spark, d):
    """Events in order of time: none is later than the watermark allows."""
    return feeds.streamed(spark, read(spark, d, "events"), "ts", lambda s: s.withWatermark("ts", "2 days").groupBy(F.col("event_type").alias("author"), F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select("author", F.col("w.start").cast("timestamp_ntz").alias("day"), "n"))


@query("ss02_sliding_windows", "SELECT user_id, CAST(epoch(date_trunc('hour', ts)) - h * 3600 AS BIGINT) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events, (SELECT unnest([0, 1, 2]) AS h) GROUP BY 1, 2")
def ss02(spark, d):
    w = lambda s: s.withWatermark("ts", "2 days").groupBy("user_id", F.window("ts", "3 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("user_id", F.unix_timestamp("w.start").alias("start"), "n", "total")
    return feeds.streamed(spark, read(spark, d, "events"), "ts", w)


@query("ss03_session_windows", f"WITH {EVENTS_SQL}, f AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= 86400 THEN 1 ELSE 0 END AS new FROM msgs WINDOW w AS (PARTITION BY thread_id ORDER BY ts, msg_id)), t AS (SELECT *, sum(new) OVER (PARTITION BY thread_id ORDER BY ts, msg_id ROWS UNBOUNDED PRECEDING) AS s FROM f) SELECT thread_id, count(*) AS n, min(ts) AS start FROM t GROUP BY thread_id, s")
def ss03(spark, d):
    m = event_messages(spark, d).withColumn("at", F.timestamp_seconds("ts"))
    w = lambda s: s.withWatermark("at", "3 days").groupBy("thread_id", times.sessions_of(F.col("at"), 86_400).alias("w")).agg(F.count("*").alias("n")).select("thread_id", "n", F.unix_timestamp("w.start").alias("start"))
    return feeds.streamed(spark, m, "at", w)


def delivered(spark, d, jitter: int):
    """Units with the delivery of five in which they come: by day, up to jitter - 1 days late."""
    day = F.floor(F.col("start_ts") / 86400) - 19723 + F.col("unit_id") % jitter
    return units(spark, d).withColumn("part", F.greatest(F.lit(0), F.least(F.lit(4), F.floor(day / 6))).cast("int"))


@query("ss03_exact_sessions", SESSIONS_SQL)
def ss03_exact(spark, d):
    """The rows of wn05 from a stream whose events come out of order, none of them behind the watermark."""
    return sessions.replayed_sessions(spark, delivered(spark, d, 3), "part", 5, "5 days", cap=300).sessions()


@query("ss01_late_rows", f"WITH {EVENTS_SQL}, u AS (SELECT thread_id, msg_id AS unit_id, ts, greatest(0, least(4, (ts // 86400 - 19723 + msg_id % 5) // 6)) AS part FROM msgs), w AS (SELECT part, max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 43200 AS mark FROM u GROUP BY part) SELECT thread_id, unit_id, ts AS start_ts FROM u JOIN w USING (part) WHERE ts < mark")
def ss01_late(spark, d):
    """Events that come behind a watermark of half a day: rows of their own, in no session."""
    return sessions.replayed_sessions(spark, delivered(spark, d, 5), "part", 5, "12 hours", cap=300).late()


@query("id06_people_overlay", "SELECT * FROM (VALUES (1, 'Me', 'AUTOMOBILE', 'c1'), (2, 'Ann', 'BUILDING', 'c2'), (2, 'Ann', 'BUILDING', 'c4')) t(person_id, name, platform, raw_id) UNION ALL SELECT CAST(10 + n_nationkey AS INTEGER), n_name, 'nation', 'n' || n_nationkey FROM nation WHERE n_nationkey NOT IN (3, 5)")
def id06(spark, d):
    """People made, an account attached away from another, one renamed, one taken off, one deleted."""
    n = read(spark, d, "nation")
    people = spark.createDataFrame([(1, "Me")], "person_id int, name string").unionByName(n.select((F.col("n_nationkey") + 10).alias("person_id"), F.col("n_name").alias("name")))
    members = spark.createDataFrame([("AUTOMOBILE", "c1", "", 1)], "platform string, raw_id string, chat string, person_id int")
    members = members.unionByName(n.select(F.lit("nation").alias("platform"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("raw_id"), F.lit("").alias("chat"), (F.col("n_nationkey") + 10).alias("person_id")))
    p = identity.People(people, members)
    p = p.attach(1, [("BUILDING", "c2", "")]).rename(13, "Ghost").delete(13).detach(("nation", "n5", ""))
    p = identity.People(p.people.unionByName(spark.createDataFrame([(2, "Bob")], "person_id int, name string")), p.members)
    p = p.rename(2, "Ann").attach(2, [("BUILDING", "c2", ""), ("BUILDING", "c4", "")])
    return p.people.join(p.members, "person_id").select("person_id", "name", "platform", "raw_id")


@query("id08_ghost_authors", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'cache' || p_partkey WHEN p_partkey % 3 = 0 THEN 'mention' || p_partkey WHEN p_partkey % 5 = 0 THEN 'reply' || p_partkey ELSE 'unknown' END AS author FROM part")
def id08(spark, d):
    g = read(spark, d, "part").select(F.col("p_partkey").alias("id"))
    named = lambda k, w: g.filter(f"id % {k} = 0").select("id", F.concat(F.lit(w), F.col("id").cast("string")).alias("author"))
    return identity.ghost_authors(g, [named(2, "cache"), named(3, "mention"), named(5, "reply")])


@query("id09_ancestor_chains", """WITH RECURSIVE s AS (SELECT event_id AS id, event_id // 3 AS parent, CASE WHEN event_id % 2 = 0 THEN 'own' ELSE 'cache' END AS src FROM events WHERE event_id > 0 AND event_id % 7 <> 0),
 w AS (SELECT event_id AS start, event_id AS id, 0 AS depth FROM events WHERE event_id % 10 = 1 UNION ALL SELECT w.start, s.parent, w.depth + 1 FROM w JOIN s USING (id))
 SELECT w.start, w.id, w.depth, coalesce(src, 'ghost') AS src FROM w LEFT JOIN s USING (id)""")  # fmt: skip
def id09(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("id"), F.floor(F.col("event_id") / 3).cast("long").alias("parent"))
    known = e.filter("id > 0 and id % 7 <> 0")
    starts = e.filter("id % 10 = 1").select(F.col("id").alias("start"))
    return identity.ancestor_chains(starts, [("own", known.filter("id % 2 = 0")), ("cache", known)])


@query("wn14_occurrences", f"WITH {EVENTS_SQL} SELECT msg_id, row_number() OVER (PARTITION BY thread_id, author ORDER BY ts, msg_id) AS k FROM msgs")
def wn14(spark, d):
    return event_messages(spark, d).select("msg_id", F.row_number().over(Window.partitionBy("thread_id", "author").orderBy("ts", "msg_id")).alias("k"))
