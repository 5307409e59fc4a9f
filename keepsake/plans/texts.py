"""Text, time, number and list functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import times, vectors
from ..operators import conversations as cv
from ..operators import graph
from ..sources.archive import CHATS_SQL, EVENTS_SQL, chat_messages, event_messages, read
from .registry import query
from .rows import THREADS_SQL, threads


def at_utc(seconds, fmt: str):
    return F.date_format(times.local(seconds, 0), fmt)


@query("fs02_slugs", "SELECT c_custkey, 'aé_' || c_nationkey || '_' || lower(replace(c_name, '#', '')) AS slug FROM customer")
def fs02(spark, d):
    """A full-width letter, a ligature of blanks, signs that go."""
    name = F.concat(F.lit("ＡÉ  "), F.col("c_nationkey").cast("string"), F.lit("!? "), F.col("c_name"))
    return read(spark, d, "customer").select("c_custkey", tx.slug(name).alias("slug"))


@query("fs06_shown_names", """WITH t AS (SELECT o_orderkey AS id, ['discord', 'whatsapp', 'reddit', 'twitter'][1 + o_orderkey % 4] AS platform, CASE WHEN o_orderkey % 4 = 1 THEN '9198765' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'u/' ELSE '' END || 'r' || o_orderkey END AS raw, CASE o_orderkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'n' || o_orderkey END AS dn, CASE WHEN o_orderkey % 8 = 3 THEN 'h' || o_orderkey END AS known FROM orders),
 p AS (SELECT *, coalesce(nullif(trim(coalesce(dn, '')), ''), raw) AS plain FROM t)
 SELECT id, CASE platform WHEN 'twitter' THEN '@' || coalesce(known, plain) WHEN 'reddit' THEN CASE WHEN starts_with(plain, 'u/') THEN plain ELSE 'u/' || plain END WHEN 'whatsapp' THEN CASE WHEN regexp_matches(plain, '^[0-9]+$') THEN '+' || plain[1:2] || ' ' || plain[3:4] || '··· ··' || plain[-3:] ELSE plain END ELSE plain END AS name FROM p""")  # fmt: skip
def fs06(spark, d):
    k, s = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    platform = F.element_at(F.array(*map(F.lit, ("discord", "whatsapp", "reddit", "twitter"))), (k % 4 + 1).cast("int"))
    raw = F.when(k % 4 == 1, F.concat(F.lit("9198765"), F.lpad((k % 100000).cast("string"), 5, "0"))).otherwise(F.concat(F.when(k % 5 == 0, "u/").otherwise(""), F.lit("r"), s))
    dn = F.when(k % 3 == 0, " ").when(k % 3 == 1, F.concat(F.lit("n"), s))
    return read(spark, d, "orders").select(k.alias("id"), tx.shown_name(platform, raw, dn, F.when(k % 8 == 3, F.concat(F.lit("h"), s))).alias("name"))


@query("fs10_old_estimates", "SELECT doc_id, CAST(floor(len(regexp_extract_all(coalesce(text, ''), '\\S+')) * 1.3::DOUBLE) AS INTEGER) AS by_words, CAST(length(coalesce(text, '')) // 2 AS INTEGER) AS by_chars FROM documents WHERE lang <> 'zh' OR lang IS NULL")
def fs10(spark, d):
    doc = read(spark, d, "documents", "doc_id", "text", "lang").filter("lang <> 'zh' or lang is null")
    return doc.select("doc_id", tx.old_token_estimate(F.col("text")).alias("e")).select("doc_id", "e.*")


HEADERS = f"""WITH {THREADS_SQL}, w AS (SELECT *, list_transform(range(1, 2 + id % 9), lambda k: 'P' || k) AS who, CASE id % 4 WHEN 2 THEN 'r/pics' WHEN 3 THEN '' WHEN 1 THEN 'P1 [12]' ELSE '12345' END AS said FROM t)
 SELECT id, array_to_string(list_filter([CASE platform WHEN 'discord' THEN 'Discord' WHEN 'whatsapp' THEN 'WhatsApp' WHEN 'facebook' THEN 'Facebook' WHEN 'instagram' THEN 'Instagram' WHEN 'reddit' THEN 'Reddit' ELSE 'Twitter' END || ' chat', array_to_string(who[1:6], ', ') || CASE WHEN len(who) > 6 THEN ' +' || len(who) - 6 ELSE '' END, '2024-01-0' || 1 + id % 9, CASE WHEN said = 'r/pics' THEN said END], lambda x: x IS NOT NULL), ' · ') AS header FROM w"""


@query("fs12_headers", HEADERS)
def fs12(spark, d):
    """A title of digits is none; one that is among the names is left out."""
    t, k = threads(spark, d), F.col("id")
    who = F.transform(F.sequence(F.lit(1).cast("long"), 1 + k % 9), lambda x: F.concat(F.lit("P"), x.cast("string")))
    title = F.when(k % 4 == 2, "r/pics").when(k % 4 == 3, "").when(k % 4 == 1, "P1 [12]").otherwise("12345")
    return t.select("id", tx.header(F.col("platform"), F.lit("chat"), who, F.concat(F.lit("2024-01-0"), (1 + k % 9).cast("string")), title).alias("header"))


@query("fs13_ancestor_heads", """WITH RECURSIVE e AS (SELECT event_id AS id, CASE WHEN event_id > 0 THEN event_id // 3 END AS parent, event_type || ' ' || event_id AS text FROM events),
 w AS (SELECT id AS start, parent AS at, 1 AS hop FROM e WHERE parent IS NOT NULL UNION ALL SELECT w.start, e.parent, w.hop + 1 FROM w JOIN e ON e.id = w.at WHERE w.hop < 6 AND e.parent IS NOT NULL)
 SELECT start AS id, string_agg(e.text, ' > ' ORDER BY hop DESC) AS head FROM w JOIN e ON e.id = w.at GROUP BY 1""")  # fmt: skip
def fs13(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") > 0, F.floor(F.col("event_id") / 3).cast("long")).alias("parent"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("text"))
    return cv.ancestor_heads(e, hops=6, cap=10_000)


@query("fs13_shrunk_heads", """WITH RECURSIVE h AS (SELECT event_id AS id, repeat('word ', CAST(event_id % 60 AS INTEGER)) || event_id AS text FROM events WHERE event_id > 0),
 s AS (SELECT id, CAST(length(text) AS BIGINT) AS n FROM h UNION ALL SELECT id, n * 8 // 10 FROM s WHERE n > 100)
 SELECT id, min(n) AS n FROM s GROUP BY 1""")  # fmt: skip
def fs13b(spark, d):
    """Heads of parents with long texts are cut by a fifth until they are short enough."""
    e = read(spark, d, "events").select(F.col("event_id").alias("k"))
    text = F.concat(F.repeat(F.lit("word "), (F.col("k") % 60).cast("int")), F.col("k").cast("string"))
    pairs = e.filter("k > 0").select(F.explode(F.array(F.struct((F.col("k") * 2).alias("id"), (F.col("k") * 2 + 1).alias("parent"), F.lit("").alias("text")), F.struct((F.col("k") * 2 + 1).alias("id"), F.lit(None).cast("long").alias("parent"), text.alias("text")))).alias("r")).select("r.*")
    return cv.ancestor_heads(pairs, hops=6, cap=100).select((F.col("id") / 2).cast("long").alias("id"), F.length("head").cast("long").alias("n"))


@query("fs23_chat_titles", "SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'DMs with Ann' WHEN 3 THEN 'Plans' WHEN 4 THEN 'reddit threads' END AS title FROM orders")
def fs23(spark, d):
    k = F.col("o_orderkey")
    title = F.element_at(F.array(*map(F.lit, ("Direct Messages - Ann", "DM 77", "12345", "Plans [99]", "reddit threads", "Tweet thread"))), (k % 6 + 1).cast("int"))
    return read(spark, d, "orders").select(k.alias("id"), tx.chat_title(title).alias("title"))


@query("fs25_verified_names", "SELECT s_suppkey AS id, s_suppkey % 4 <> 3 AS verified FROM supplier")
def fs25(spark, d):
    k, name = F.col("s_suppkey"), F.col("s_name")
    said = F.when(k % 4 == 0, F.concat(F.lit("well, I'm "), name, F.lit("."))).when(k % 4 == 1, F.concat(F.lit("Hey "), F.upper(name))).when(k % 4 == 2, F.concat(F.lit("my name is "), name, F.lit("!"))).otherwise(F.concat(F.lit("about "), name, F.lit(" and say hi "), name, F.lit("x")))
    return read(spark, d, "supplier").select(k.alias("id"), tx.verified_name(name, F.array(F.lit("no"), said)).alias("verified"))


@query("fs26_undated_facts", "SELECT o_orderkey AS id, 'Lives in ' || o_orderpriority AS fact FROM orders")
def fs26(spark, d):
    before = F.element_at(F.array(*map(F.lit, ("", "As of 3 May 2024, ", "As of May 3, 2024, ", "As of 2024-05-03, "))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    text = F.concat(before, F.when(F.col("o_orderkey") % 2 == 0, "lives in ").otherwise("Lives in "), "o_orderpriority")
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), tx.undated_fact(text).alias("fact"))


@query("fs27_transcript_lines", f"WITH {CHATS_SQL} SELECT msg_id, CASE WHEN turn % 5 <> 4 THEN 't' || turn END AS at, CASE WHEN turn % 5 <> 4 THEN author END AS who, CASE WHEN turn % 5 <> 4 THEN md5(content) END AS h FROM chats")
def fs27(spark, d):
    m = chat_messages(spark, d)
    line = F.when(F.col("turn") % 5 == 4, F.lit("no line [x]")).otherwise(F.concat(F.lit("[t"), F.col("turn").cast("string"), F.lit("] "), "author", F.lit(": "), "content"))
    return m.select("msg_id", tx.transcript_parts(line).alias("p")).select("msg_id", "p.at", "p.who", F.md5(F.col("p.said").cast("binary")).alias("h"))


@query("fs28_titles_and_initials", "SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN 'Ann, Bo' WHEN 1 THEN 'Trip ' || n_name ELSE 'Reddit post' END AS title, CASE WHEN n_nationkey % 2 = 0 THEN 'N' || substr(CAST(n_nationkey AS VARCHAR), 1, 1) ELSE 'É' END AS initials FROM nation")
def fs28(spark, d):
    k = F.col("n_nationkey")
    header = F.when(k % 3 == 0, "WhatsApp chat · Ann, Bo · 2024-01-01").when(k % 3 == 1, F.concat(F.lit("WhatsApp chat · Ann · 2024-01-01 – 2024-02-01 · Trip "), "n_name")).otherwise("Reddit post")
    name = F.when(k % 2 == 0, F.concat(F.lit("  (nation) x "), k.cast("string"))).otherwise("«élan»")
    return read(spark, d, "nation").select(k.alias("id"), tx.session_title(header).alias("title"), tx.initials(name).alias("initials"))


A, B = ("calm", "brisk", "lucky", "quiet", "sunny"), ("otter", "maple", "comet", "river", "ember", "finch", "cedar")


@query("fs29_aliases", f"SELECT c_custkey, {list(A)}[1 + ('0x' || substr(md5(c_name), 1, 6))::BIGINT % 5] || ' ' || {list(B)}[1 + ('0x' || substr(md5(c_name), 7, 6))::BIGINT % 7] AS alias FROM customer")
def fs29(spark, d):
    return read(spark, d, "customer").select("c_custkey", tx.alias_of(F.col("c_name"), A, B).alias("alias"))


@query("fs31_calendar_text", "SELECT p_partkey, replace(p_name, ' ', chr(92) || ', ') || chr(92) || chr(92) || p_brand || chr(92) || '; x' AS t FROM part")
def fs31(spark, d):
    raw = F.concat(F.replace("p_name", F.lit(" "), F.lit(", ")), F.lit("\\"), "p_brand", F.lit(";\nx"))
    return read(spark, d, "part").select("p_partkey", tx.ics_escaped(raw).alias("t"))


@query("fd02_offsets", "SELECT event_id, CAST(floor(epoch(date_trunc('second', ts))) AS BIGINT) AS replaced, CAST(floor(epoch(date_trunc('second', ts))) AS BIGINT) - CASE event_id % 3 WHEN 0 THEN 19800 WHEN 1 THEN -12600 ELSE 0 END AS converted FROM events")
def fd02(spark, d):
    k = F.col("event_id") % 3
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.when(k == 0, "+05:30").when(k == 1, "-0330").otherwise("Z"))
    return read(spark, d, "events").select("event_id", times.stated_in_utc(text).alias("replaced"), times.converted(text).alias("converted"))


@query("fd03_milliseconds", "SELECT event_id, CAST(floor((event_id * 777 - 300000) / 1000) AS BIGINT) AS s FROM events")
def fd03(spark, d):
    return read(spark, d, "events").select("event_id", times.seconds(F.col("event_id") * 777 - 300_000).alias("s"))


@query("fd05_restamped_lines", f"WITH {EVENTS_SQL} SELECT msg_id, CASE WHEN msg_id % 6 = 5 THEN 'plain' ELSE '[' || strftime(make_timestamp(ts * 1000000) + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M') || '] ' || author || ': x' END AS line FROM msgs")
def fd05(spark, d):
    m = event_messages(spark, d)
    line = F.when(F.col("msg_id") % 6 == 5, "plain").otherwise(F.concat(F.lit("["), at_utc(F.col("ts"), "yyyy-MM-dd HH:mm"), F.lit("] "), "author", F.lit(": x")))
    return m.select("msg_id", times.restamped(line).alias("line"))


@query("fd06_redated_headers", f"WITH {EVENTS_SQL}, x AS (SELECT msg_id, strftime(make_timestamp(ts * 1000000) + INTERVAL 330 MINUTE, '%Y-%m-%d') AS a, strftime(make_timestamp((ts + msg_id % 3 * 40000) * 1000000) + INTERVAL 330 MINUTE, '%Y-%m-%d') AS b FROM msgs) SELECT msg_id, 'Chat · Ann · ' || CASE WHEN a = b THEN a ELSE a || ' – ' || b END || ' · Title 2024-01-01' AS header FROM x")
def fd06(spark, d):
    m = event_messages(spark, d)
    old = F.concat(F.lit("Chat · Ann · "), at_utc(F.col("ts"), "yyyy-MM-dd"), F.when(F.col("msg_id") % 2 == 0, " – 2030-01-01").otherwise(""), F.lit(" · Title 2024-01-01"))
    return m.select("msg_id", times.redated(old, F.col("ts"), F.col("ts") + F.col("msg_id") % 3 * 40_000).alias("header"))


@query("fd09_month_spans", "WITH x AS (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1), f AS (SELECT *, strftime(a, '%b %Y') AS fa, strftime(b, '%b %Y') AS fb FROM x) SELECT o_custkey, CASE WHEN fa = fb THEN fa WHEN year(a) = year(b) THEN strftime(a, '%b') || ' – ' || fb ELSE fa || ' – ' || fb END AS span FROM f")
def fd09(spark, d):
    g = read(spark, d, "orders").groupBy("o_custkey").agg(F.min(times.epoch(F.col("o_orderdate"))).alias("a"), F.max(times.epoch(F.col("o_orderdate"))).alias("b"))
    return g.select("o_custkey", times.month_span(F.col("a"), F.col("b"), 0).alias("span"))


@query("fd11_since_days", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '2000-06-01' - INTERVAL 7 DAY AND CAST(o_orderdate AS DATE) <= DATE '2000-06-01'")
def fd11(spark, d):
    """Today is a parameter, so that a run can be repeated."""
    day, today = F.to_date("o_orderdate"), F.lit("2000-06-01")
    return read(spark, d, "orders").filter(times.since_days(day, today, 7) & (day <= F.to_date(today))).select("o_orderkey")


@query("fd13_peak_hours", "SELECT event_id, dayofweek(ts) BETWEEN 1 AND 5 AND (hour(ts) IN (1, 2, 3) OR hour(ts) BETWEEN 6 AND 9) AS peak FROM events")
def fd13(spark, d):
    return read(spark, d, "events").select("event_id", times.is_peak(F.col("ts")).alias("peak"))


@query("fm01_bit_shifts", "SELECT event_id, (event_id * 6000000001) >> 22 AS high, (event_id * 6000000001) & 4194303 AS low, event_id // 7 AS part FROM events")
def fm01(spark, d):
    n = F.col("event_id") * F.lit(6000000001)
    return read(spark, d, "events").select("event_id", F.shiftright(n, 22).alias("high"), n.bitwiseAND(F.lit(4194303)).alias("low"), F.expr("event_id div 7").alias("part"))


@query("fm02_rounding", "SELECT event_id, round(value * 1.0007, 3) AS r3, CAST(trunc(value / 3 - 10) AS BIGINT) AS whole, CAST(floor(value / 3 - 10) AS BIGINT) AS down FROM events")
def fm02(spark, d):
    v = F.col("value") / 3 - 10
    return read(spark, d, "events").select("event_id", F.round(F.col("value") * 1.0007, 3).alias("r3"), v.cast("long").alias("whole"), F.floor(v).alias("down"))


@query("fm03_clamped_logs", "SELECT event_id, round(ln(1 + value), 9) AS log1p, round(sqrt(value), 9) AS root, least(greatest(value, 10), 60) AS clamped FROM events")
def fm03(spark, d):
    v = F.col("value")
    return read(spark, d, "events").select("event_id", F.round(F.log1p(v), 9).alias("log1p"), F.round(F.sqrt(v), 9).alias("root"), F.least(F.greatest(v, F.lit(10.0)), F.lit(60.0)).alias("clamped"))


@query("fm05_two_logits", "SELECT event_id, round(exp(value / 10) / (exp(value / 10) + exp(5)), 9) AS p FROM events")
def fm05(spark, d):
    return read(spark, d, "events").select("event_id", F.round(vectors.softmax_yes(F.col("value") / 10, F.lit(5.0)), 9).alias("p"))


@query("fm06_caps", "WITH p AS (SELECT c_custkey AS id, 1 - (c_custkey % 100 + 0.5) / 100 * (1 - cos(0.3)) AS z, c_custkey * 2.399963229728653 AS a FROM customer) SELECT id, round(sqrt(1 - z * z) * cos(a), 6) AS x, round(sqrt(1 - z * z) * sin(a), 6) AS y, round(z, 6) AS z FROM p")
def fm06(spark, d):
    """Places in a cap of a sphere about its pole, by index and golden angle."""
    p = graph.on_cap(read(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 100).alias("k")), F.lit(100), 0.3)
    return p.select("id", *(F.round(c, 6).alias(c) for c in "xyz"))


@query("fm07_main_axes", "SELECT true AS orthogonal, true AS unit, true AS along")
def fm07(spark, d):
    """A cloud drawn out along (3, 4, 0): the first axis is that direction, the second is at right angles to it."""
    k = F.col("event_id")
    a, b = (k % 1000) / 10 - 50, ((k * 7) % 11) / 10 - 0.5
    pts = read(spark, d, "events").select((a * 0.6 - b * 0.8).alias("x"), (a * 0.8 + b * 0.6).alias("y"), (((k * 13) % 7) / 70).alias("z"))
    _, (u, v) = graph.axes_of(pts)
    dot = lambda p, q: sum(i * j for i, j in zip(p, q, strict=True))
    return spark.createDataFrame([(abs(dot(u, v)) < 1e-9, abs(dot(u, u) - 1) < 1e-9 and abs(dot(v, v) - 1) < 1e-9, abs(abs(dot(u, (0.6, 0.8, 0))) - 1) < 0.01)], "orthogonal boolean, unit boolean, along boolean")


@query("fm08_prices", "SELECT o_orderpriority AS model, round(sum(o_orderkey * 0.27 + o_custkey * 1.1 * CASE WHEN hour(o_orderdate) = 0 THEN 0.5 ELSE 1 END) / 1000000, 3) AS cost FROM orders GROUP BY 1")
def fm08(spark, d):
    """Tokens in and out at their prices a million, the latter cheaper off peak."""
    part = F.col("o_orderkey") * 0.27 + F.col("o_custkey") * 1.1 * F.when(F.hour("o_orderdate") == 0, 0.5).otherwise(1.0)
    return read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(F.round(F.sum(part) / 1_000_000, 3).alias("cost"))


@query("fa01_json_arrays", "SELECT o_custkey, '[' || string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) || ']' AS j, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders GROUP BY 1")
def fa01(spark, d):
    g = read(spark, d, "orders").groupBy("o_custkey").agg(F.to_json(F.array_sort(F.collect_list("o_orderkey"))).alias("j"))
    return g.select("o_custkey", "j", F.aggregate(F.from_json("j", "array<long>"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("fa02_json_paths", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def fa02(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("fa03_json_each", "SELECT o_custkey AS v, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1 HAVING count(*) > 0")
def fa03(spark, d):
    j = read(spark, d, "orders").filter("o_orderkey % 2 = 0").groupBy((F.col("o_orderkey") % 8).alias("b")).agg(F.to_json(F.collect_list("o_custkey")).alias("j"))
    return j.select(F.explode(F.from_json("j", "array<long>")).alias("v")).groupBy("v").agg(F.count("*").alias("n"))


@query("fa05_last_aliases", "WITH l AS (SELECT o_orderkey AS id, list_transform(range(1, 1 + o_orderkey % 30), lambda k: 'a' || k) AS a, 'a' || o_orderkey % 7 AS x FROM orders), m AS (SELECT id, CASE WHEN list_contains(a, x) THEN a ELSE list_append(a, x) END AS a FROM l) SELECT id, a[greatest(len(a) - 19, 1):] AS aliases FROM m")
def fa05(spark, d):
    k = F.col("o_orderkey")
    a = F.when(k % 30 > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(k % 30, F.lit(1))), lambda x: F.concat(F.lit("a"), x.cast("string")))).otherwise(F.array().cast("array<string>"))
    return read(spark, d, "orders").select(k.alias("id"), tx.with_alias(a, F.concat(F.lit("a"), (k % 7).cast("string"))).alias("aliases"))


@query("fa06_rekeyed_json", "SELECT o_orderkey, '[\"A_' || CASE WHEN o_custkey % 10 = 3 THEN o_custkey + 100000 ELSE o_custkey END || '\",\"A_13x\"]' AS nodes FROM orders")
def fa06(spark, d):
    """Nodes in a JSON list, whole ones only: A_13x isn't A_13."""
    from ..operators import identity

    o = read(spark, d, "orders").select("o_orderkey", F.to_json(F.array(F.concat(F.lit("A_"), F.col("o_custkey").cast("string")), F.lit("A_13x"))).alias("j"))
    moved = read(spark, d, "customer").filter("c_custkey % 10 = 3").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 100000).alias("new"))
    return identity.rekeyed(o.withColumn("nodes", F.from_json("j", "array<string>")), "nodes", moved).select("o_orderkey", F.to_json("nodes").alias("nodes"))


@query("fa07_depths", f"""WITH RECURSIVE {CHATS_SQL}, t AS (SELECT thread_id, msg_id, 0 AS depth FROM chats WHERE parent_id IS NULL OR parent_id NOT IN (SELECT msg_id FROM chats) UNION ALL SELECT c.thread_id, c.msg_id, t.depth + 1 FROM t JOIN chats c ON c.parent_id = t.msg_id)
 SELECT thread_id, max(depth) AS deepest, count(*) AS n FROM t GROUP BY 1""")  # fmt: skip
def fa07(spark, d):
    return cv.reply_paths(chat_messages(spark, d)).groupBy("thread_id").agg(F.max(F.size("path") - 1).alias("deepest"), F.count("*").alias("n"))


@query("fa08_keyword_bags", "SELECT p_partkey, array_to_string(list_concat(string_split(p_name, ' '), list_filter([lower(p_type)], lambda x: NOT list_contains(string_split(p_name, ' '), x))), ' ') AS bag FROM part WHERE string_split(p_name, ' ')[1] <> string_split(p_name, ' ')[2]")
def fa08(spark, d):
    p = read(spark, d, "part").filter(F.element_at(F.split("p_name", " "), 1) != F.element_at(F.split("p_name", " "), 2))
    return p.select("p_partkey", tx.keyword_bag(F.split("p_name", " "), F.lit(None).cast("array<string>"), F.array(F.lower("p_type"))).alias("bag"))
