"""Filters, joins, aggregates, set operations and top-k over the archive, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import times
from ..functions.text import thread_group
from ..operators import graph, memory, selection, spans, tables
from ..sources.archive import CHATS_SQL, EVENTS_SQL, chat_messages, event_messages, read
from .registry import query

LOCAL_DAY = "strftime(make_timestamp((ts + 19800) * 1000000), '%Y-%m-%d')"
LOCAL_MONTH = "strftime(make_timestamp((ts + 19800) * 1000000), '%Y-%m')"
#: The dimension tables as the archive's accounts: platform is the region, person the nation.
ACCOUNTS_SQL = """accounts AS (SELECT c_custkey AS account_id, c_name AS name, r_name AS platform, n_nationkey AS person_id, c_acctbal AS balance
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def accounts(spark, d):
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return read(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("account_id"), F.col("c_name").alias("name"), F.col("r_name").alias("platform"), F.col("n_nationkey").alias("person_id"), F.col("c_acctbal").alias("balance"))


# ---- filters and predicates


@query("pf03_skip_reasons", f"WITH {CHATS_SQL} SELECT CASE WHEN ts % 11 = 0 THEN 'no_timestamp' WHEN length(content) < 40 THEN 'empty' ELSE 'kept' END AS reason, count(*) AS n FROM chats GROUP BY 1")
def pf03(spark, d):
    reason = F.when(F.col("ts") % 11 == 0, "no_timestamp").when(F.length("content") < 40, "empty").otherwise("kept")
    return chat_messages(spark, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("pf04_optional_filters", f"WITH {EVENTS_SQL} SELECT msg_id, author, ts FROM msgs WHERE author = 'view' AND ts >= 1704500000 AND ts < 1705500000")
def pf04(spark, d):
    wanted = {"author": "view", "since": 1704500000, "until": 1705500000, "thread": None}
    tests = {"author": lambda v: F.col("author") == v, "since": lambda v: F.col("ts") >= v, "until": lambda v: F.col("ts") < v, "thread": lambda v: F.col("thread_id") == v}
    rows = event_messages(spark, d)
    for k, v in wanted.items():
        rows = rows if v is None else rows.filter(tests[k](v))
    return rows.select("msg_id", "author", "ts")


@query("pf05_span_overlap", f"WITH {EVENTS_SQL}, s AS (SELECT thread_id, min(ts) AS a, max(ts) AS b FROM msgs GROUP BY 1) SELECT thread_id, a, b FROM s WHERE b >= 1704200000 AND a <= 1704100000")
def pf05(spark, d):
    s = event_messages(spark, d).groupBy("thread_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return s.filter((F.col("b") >= 1704200000) & (F.col("a") <= 1704100000))


@query("pf06_arrays_overlap", f"WITH {EVENTS_SQL}, s AS (SELECT thread_id, list(DISTINCT author) AS who FROM msgs GROUP BY 1) SELECT thread_id, len(who) AS n FROM s WHERE list_has_any(who, ['signup', 'error'])")
def pf06(spark, d):
    s = event_messages(spark, d).groupBy("thread_id").agg(F.collect_set("author").alias("who"))
    return s.filter(F.arrays_overlap("who", F.array(F.lit("signup"), F.lit("error")))).select("thread_id", F.size("who").cast("long").alias("n"))


@query("pf08_contains", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a1') OR contains(lower(p_brand), '#2')")
def pf08(spark, d):
    return read(spark, d, "part").filter(F.lower("p_name").contains("a1") | F.lower("p_brand").contains("#2")).select("p_partkey", "p_name")


@query("pf09_suffix", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%\\_07' ESCAPE '\\' OR c_name LIKE '%07'")
def pf09(spark, d):
    return read(spark, d, "customer").filter(F.col("c_name").endswith("_07") | F.col("c_name").endswith("07")).select("c_custkey", "c_name")


@query("pf10_digits", "SELECT regexp_matches(c_name, '[0-9]$') AS ends, regexp_matches(c_mktsegment, '^[0-9]*$') AS digits, count(*) AS n FROM customer GROUP BY 1, 2")
def pf10(spark, d):
    return read(spark, d, "customer").groupBy(F.col("c_name").rlike("[0-9]$").alias("ends"), F.col("c_mktsegment").rlike("^[0-9]*$").alias("digits")).agg(F.count("*").alias("n"))


@query("pf14_current_items", "SELECT count(*) AS n, count(due) AS dated FROM (SELECT CAST(o_orderdate AS DATE) AS said, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) + INTERVAL 10 DAY END AS due FROM orders) WHERE CASE WHEN due IS NOT NULL THEN due >= DATE '1998-01-01' - INTERVAL 7 DAY ELSE said >= DATE '1998-01-01' - INTERVAL 21 DAY END")
def pf14(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("said_on"), F.when(F.col("o_orderkey") % 3 != 0, F.date_add(F.col("o_orderdate").cast("date"), 10)).alias("due"))
    return o.filter(memory.current_items(o, F.lit("1998-01-01").cast("date"))).agg(F.count("*").alias("n"), F.count("due").alias("dated"))


INBOX_SQL = """items AS (SELECT o_orderkey AS cid, CASE WHEN o_orderkey % 2 = 0 THEN 'me' ELSE 'them' END AS owner, CAST(o_orderdate AS DATE) AS said_on,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) + INTERVAL 10 DAY END AS due, o_orderstatus AS st, o_orderpriority AS area, o_orderkey % 7 = 0 AS reopened FROM orders),
 b AS (SELECT *, CASE WHEN NOT (CASE WHEN due IS NOT NULL THEN due >= DATE '1997-06-01' - INTERVAL 7 DAY ELSE said_on >= DATE '1997-06-01' - INTERVAL 21 DAY END AND owner = 'me') THEN 'older'
   WHEN st <> 'O' AND NOT reopened THEN 'cleared' ELSE 'now' END AS bucket FROM items)"""


def inbox(spark, d):
    o = read(spark, d, "orders")
    items = o.select(
        F.col("o_orderkey").alias("cid"), F.when(F.col("o_orderkey") % 2 == 0, "me").otherwise("them").alias("owner"), F.col("o_orderdate").cast("date").alias("said_on"),
        F.when(F.col("o_orderkey") % 3 != 0, F.date_add(F.col("o_orderdate").cast("date"), 10)).alias("due"), F.col("o_orderstatus").alias("st"), F.col("o_orderpriority").alias("area"), (F.col("o_orderkey") % 7 == 0).alias("reopened"),
    )
    today = F.lit("1997-06-01").cast("date")
    verdict = F.when(F.col("st") == "O", "pending").otherwise("done")
    return items.withColumn("status", memory.bucket(memory.current_items(items, today), F.col("owner") == "me", verdict, F.col("reopened"))).withColumn("text", F.concat_ws(" ", "area", F.col("cid").cast("string")))


@query("pf15_buckets", f"WITH {INBOX_SQL} SELECT bucket, owner, count(*) AS n FROM b GROUP BY 1, 2")
def pf15(spark, d):
    return inbox(spark, d).groupBy(F.col("status").alias("bucket"), "owner").agg(F.count("*").alias("n"))


@query("pf18_enum_fallback", "SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority ELSE 'other' END AS kind, count(*) AS n FROM orders GROUP BY 1")
def pf18(spark, d):
    kind = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_orderpriority")).otherwise("other")
    return read(spark, d, "orders").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("pf21_thread_groups", """SELECT grp, count(*) AS n FROM (SELECT CASE WHEN p IN ('discord', 'whatsapp') THEN p || '_dm_group' WHEN p IN ('facebook', 'instagram') THEN p || CASE WHEN starts_with(t, 'comment on') THEN '_comment_thread' ELSE '_dm_group' END
  WHEN p = 'reddit' THEN CASE WHEN starts_with(t, 'dm') OR contains(k, ':reddit.com') THEN 'reddit_dm_group' ELSE 'reddit_public_thread' END WHEN p = 'twitter' THEN CASE WHEN starts_with(t, 'dm') THEN 'twitter_dm_group' ELSE 'twitter_public_thread' END ELSE p || '_public_thread' END AS grp
  FROM (SELECT ['twitter', 'reddit', 'discord', 'instagram', 'facebook', 'whatsapp', 'mail'][CAST(conv_id % 7 AS INT) + 1] AS p, CASE conv_id % 3 WHEN 0 THEN 'dm with x' WHEN 1 THEN 'comment on y' ELSE 'hello' END AS t, CASE WHEN conv_id % 5 = 0 THEN 'x:reddit.com' ELSE 'y' END AS k FROM conversations)) GROUP BY 1""")  # fmt: skip
def pf21(spark, d):
    c = F.col("conv_id")
    names = F.array(*map(F.lit, ("twitter", "reddit", "discord", "instagram", "facebook", "whatsapp", "mail")))
    g = thread_group(F.element_at(names, (c % 7 + 1).cast("int")), F.when(c % 3 == 0, "DM with x").when(c % 3 == 1, "Comment on y").otherwise("hello"), F.when(c % 5 == 0, "x:reddit.com").otherwise("y"))
    return read(spark, d, "conversations", "conv_id").groupBy(g.alias("grp")).agg(F.count("*").alias("n"))


@query("pf23_truncated_rows", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '…' ELSE text END AS text FROM (SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 51)")
def pf23(spark, d):
    t = F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("…"))).otherwise(F.col("text"))
    return read(spark, d, "documents", "doc_id", "text").orderBy("doc_id").limit(51).select("doc_id", t.alias("text"))


@query("pf25_participation", f"WITH {EVENTS_SQL} SELECT thread_id, count(*) AS n FROM msgs GROUP BY 1 HAVING bool_or(is_me)")
def pf25(spark, d):
    return event_messages(spark, d).groupBy("thread_id").agg(F.count("*").alias("n"), F.bool_or("is_me").alias("me")).filter("me").drop("me")


# ---- joins


@query("jn01_message_facts", f"WITH {EVENTS_SQL}, {ACCOUNTS_SQL} SELECT msg_id, account_id, platform, is_me, ts, {LOCAL_DAY} AS day FROM msgs JOIN accounts ON account_id = thread_id")
def jn01(spark, d):
    m = event_messages(spark, d).join(accounts(spark, d), F.col("account_id") == F.col("thread_id"))
    return m.select("msg_id", "account_id", "platform", "is_me", "ts", times.local_day(F.col("ts")).alias("day"))


@query("jn02_override_map", "WITH o AS (SELECT o_custkey, max(o_orderkey) AS own FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1) SELECT c_custkey, coalesce(own, c_nationkey) AS account FROM customer LEFT JOIN o ON o_custkey = c_custkey")
def jn02(spark, d):
    o = read(spark, d, "orders").filter("o_orderkey % 5 = 0").groupBy("o_custkey").agg(F.max("o_orderkey").alias("own"))
    return read(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("own", "c_nationkey").cast("long").alias("account"))


@query("jn03_optional_enrichment", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN (SELECT * FROM labels WHERE toxic = 0) l ON l.doc_id = d.doc_id")
def jn03(spark, d):
    l = read(spark, d, "labels").filter("toxic = 0").select("doc_id", "quality")
    return read(spark, d, "documents", "doc_id").join(l, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("jn04_semi", f"WITH {EVENTS_SQL} SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT thread_id FROM msgs WHERE is_me)")
def jn04(spark, d):
    return read(spark, d, "customer").join(event_messages(spark, d).filter("is_me").select(F.col("thread_id").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("jn05_anti", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def jn05(spark, d):
    return read(spark, d, "customer", "c_custkey").join(read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("jn06_cross_thread_replies", f"WITH {EVENTS_SQL} SELECT c.thread_id AS a, p.thread_id AS b, count(*) AS n FROM msgs c JOIN msgs p ON c.parent_id = p.msg_id WHERE c.thread_id <> p.thread_id GROUP BY 1, 2")
def jn06(spark, d):
    m = event_messages(spark, d)
    p = m.select(F.col("msg_id").alias("parent_id"), F.col("thread_id").alias("b"))
    return m.join(p, "parent_id").filter("thread_id <> b").groupBy(F.col("thread_id").alias("a"), "b").agg(F.count("*").alias("n"))


@query("jn07_bridge_join", "SELECT l.l_orderkey, l.l_linenumber, o.o_custkey FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'F' AND o.o_orderdate <= l.l_shipdate AND l.l_quantity > 10 WHERE l.l_linenumber = 1")
def jn07(spark, d):
    l, o = read(spark, d, "lineitem"), read(spark, d, "orders")
    on = (o.o_orderkey == l.l_orderkey) & (o.o_orderstatus == "F") & (o.o_orderdate <= l.l_shipdate) & (l.l_quantity > 10)
    return l.filter("l_linenumber = 1").join(o, on, "left").select("l_orderkey", "l_linenumber", "o_custkey")


@query("jn09_array_membership", "SELECT u.a AS account, count(*) AS n FROM (SELECT unnest([l_partkey % 10, l_suppkey % 10]) AS a FROM lineitem) u GROUP BY 1")
def jn09(spark, d):
    return read(spark, d, "lineitem").select(F.explode(F.array(F.col("l_partkey") % 10, F.col("l_suppkey") % 10)).alias("account")).groupBy("account").agg(F.count("*").alias("n"))


@query("jn10_json_unnest", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS s FROM events GROUP BY 1")
def jn10(spark, d):
    k = F.from_json("props", "k bigint")["k"]
    return read(spark, d, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.sum("event_id").alias("s"))


@query("jn12_as_of", f"WITH {EVENTS_SQL}, s AS (SELECT thread_id, ts, msg_id AS sid FROM msgs WHERE author = 'signup'), r AS (SELECT thread_id, ts, max(sid) AS sid FROM s GROUP BY 1, 2) SELECT m.msg_id, r.sid FROM (SELECT * FROM msgs WHERE author = 'click') m ASOF LEFT JOIN r ON m.thread_id = r.thread_id AND m.ts >= r.ts")
def jn12(spark, d):
    """As-of join in one shuffle: both sides in one ordered stream a key, the last right row carried forward."""
    m = event_messages(spark, d)
    right = m.filter("author = 'signup'").select("thread_id", "ts", F.lit(0).alias("side"), "msg_id")
    left = m.filter("author = 'click'").select("thread_id", "ts", F.lit(1).alias("side"), "msg_id")
    w = Window.partitionBy("thread_id").orderBy("ts", "side", "msg_id").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("sid", F.last(F.when(F.col("side") == 0, F.col("msg_id")), ignorenulls=True).over(w))
    return both.filter("side = 1").select("msg_id", "sid")


@query("jn13_neighbours", f"WITH {EVENTS_SQL}, s AS (SELECT DISTINCT thread_id, ts FROM msgs) SELECT thread_id, ts, lag(ts) OVER w AS prev_ts, lead(ts) OVER w AS next_ts FROM s WINDOW w AS (PARTITION BY thread_id ORDER BY ts)")
def jn13(spark, d):
    w = Window.partitionBy("thread_id").orderBy("ts")
    s = event_messages(spark, d).select("thread_id", "ts").distinct()
    return s.select("thread_id", "ts", F.lag("ts").over(w).alias("prev_ts"), F.lead("ts").over(w).alias("next_ts"))


@query("jn14_interval_join", f"WITH {EVENTS_SQL}, s AS (SELECT thread_id, ts // 86400 AS day, min(ts) AS a, max(ts) AS b FROM msgs GROUP BY 1, 2) SELECT x.thread_id AS t1, y.thread_id AS t2, count(*) AS n FROM s x JOIN s y ON x.day = y.day AND x.thread_id < y.thread_id AND x.b >= y.a AND x.a <= y.b GROUP BY 1, 2")
def jn14(spark, d):
    s = event_messages(spark, d).groupBy("thread_id", F.floor(F.col("ts") / 86400).alias("day")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return spans.meetings(s, "thread_id", "day").select(F.col("x").alias("t1"), F.col("y").alias("t2"), "n")


@query("jn14_open_replies", f"WITH {EVENTS_SQL}, s AS (SELECT m.thread_id, m.author, m.msg_id, least(m.ts, p.ts) AS a, greatest(m.ts, p.ts) AS b FROM msgs m JOIN msgs p ON p.msg_id = m.parent_id) SELECT x.thread_id, count(*) AS pairs, CAST(sum(least(x.b, y.b) - greatest(x.a, y.a)) AS BIGINT) AS seconds FROM s x JOIN s y ON x.thread_id = y.thread_id AND x.author < y.author AND x.a <= y.b AND y.a <= x.b GROUP BY 1")
def jn14_open_replies(spark, d):
    """Spans from a message to its reply, of seconds to weeks: how many of different authors are open at once in a thread, and for how long."""
    m = event_messages(spark, d)
    p = m.select(F.col("msg_id").alias("parent_id"), F.col("ts").alias("asked"))
    s = m.join(p, "parent_id").select("thread_id", "author", F.least("ts", "asked").alias("a"), F.greatest("ts", "asked").alias("b"))
    both = spans.overlapping(s, s, by=["thread_id"]).filter("l_author < r_author")
    return both.groupBy("thread_id").agg(F.count("*").alias("pairs"), F.sum(F.least("l_b", "r_b") - F.greatest("l_a", "r_a")).alias("seconds"))


@query("jn17_shared_members", "WITH m AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS x FROM lineitem), c AS (SELECT a.g AS a, b.g AS b, count(*) AS n FROM m a JOIN m b ON a.x = b.x AND a.g <> b.g GROUP BY 1, 2), s AS (SELECT g, count(*) AS size FROM m GROUP BY 1) SELECT c.a, c.b, c.n FROM c JOIN s ON s.g = c.a WHERE c.n >= 0.5 * s.size")
def jn17(spark, d):
    from ..operators.graph import mostly_shared

    return mostly_shared(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_partkey").alias("x")), 0.5)


@query("jn18_decorrelated", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
def jn18(spark, d):
    n = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return read(spark, d, "customer", "c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("jn19_pairs_in_groups", "WITH g AS (SELECT c_custkey // 4 AS k, c_custkey AS id FROM customer) SELECT x.k, x.id AS a, y.id AS b FROM g x JOIN g y ON x.k = y.k AND x.id < y.id WHERE x.k IN (SELECT k FROM g GROUP BY 1 HAVING count(*) BETWEEN 2 AND 6)")
def jn19(spark, d):
    g = read(spark, d, "customer").select(F.floor(F.col("c_custkey") / 4).alias("k"), F.col("c_custkey").alias("id"))
    few = g.join(g.groupBy("k").agg(F.count("*").alias("n")).filter("n between 2 and 6"), "k")
    return few.select("k", F.col("id").alias("a")).join(few.select("k", F.col("id").alias("b")), "k").filter("a < b")


@query("jn21_unique_match", "WITH u AS (SELECT s_nationkey AS k, min(s_suppkey) AS s FROM supplier GROUP BY 1 HAVING count(*) = (SELECT min(n) FROM (SELECT count(*) AS n FROM supplier GROUP BY s_nationkey))) SELECT c_custkey, s FROM customer JOIN u ON c_nationkey = k")
def jn21(spark, d):
    by = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.count("*").alias("n"), F.min("s_suppkey").alias("s"))
    least = by.agg(F.min("n").alias("m"))
    return read(spark, d, "customer").join(by.join(F.broadcast(least), F.col("n") == F.col("m")), "c_nationkey").select("c_custkey", "s")


# ---- aggregates


@query("ag01_counts", f"WITH {EVENTS_SQL} SELECT author, count(*) AS n FROM msgs GROUP BY 1")
def ag01(spark, d):
    return event_messages(spark, d).groupBy("author").agg(F.count("*").alias("n"))


@query("ag02_distinct", f"WITH {EVENTS_SQL} SELECT author, count(DISTINCT thread_id) AS n FROM msgs GROUP BY 1")
def ag02(spark, d):
    return event_messages(spark, d).groupBy("author").agg(F.count_distinct("thread_id").alias("n"))


@query("ag06_listed", f"WITH {EVENTS_SQL} SELECT thread_id, string_agg(DISTINCT author, ',' ORDER BY author) AS authors FROM msgs GROUP BY 1")
def ag06(spark, d):
    return event_messages(spark, d).groupBy("thread_id").agg(F.array_join(F.array_sort(F.collect_set("author")), ",").alias("authors"))


@query("ag07_people", f"WITH {ACCOUNTS_SQL}, {EVENTS_SQL}, c AS (SELECT thread_id AS account_id, count(*) AS n FROM msgs GROUP BY 1) SELECT person_id, count(*) AS accounts, CAST(coalesce(sum(n), 0) AS BIGINT) AS messages FROM accounts LEFT JOIN c USING (account_id) GROUP BY 1")
def ag07(spark, d):
    c = event_messages(spark, d).groupBy(F.col("thread_id").alias("account_id")).agg(F.count("*").alias("n"))
    return accounts(spark, d).join(c, "account_id", "left").groupBy("person_id").agg(F.count("*").alias("accounts"), F.coalesce(F.sum("n"), F.lit(0)).alias("messages"))


@query("ag09_two_levels", "SELECT n, count(*) AS threads FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) > 2) GROUP BY 1")
def ag09(spark, d):
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 2").groupBy("n").agg(F.count("*").alias("threads"))


@query("ag12_months", f"WITH {EVENTS_SQL} SELECT {LOCAL_DAY} AS day, {LOCAL_MONTH} AS month, count(*) AS n, CAST(sum(CAST(is_me AS INT)) AS BIGINT) AS mine FROM msgs GROUP BY 1, 2")
def ag12(spark, d):
    return event_messages(spark, d).groupBy(times.local_day(F.col("ts")).alias("day"), times.local_month(F.col("ts")).alias("month")).agg(F.count("*").alias("n"), F.sum(F.col("is_me").cast("int")).alias("mine"))


@query("ag13_nearest_rank", "WITH r AS (SELECT o_orderpriority AS p, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT DISTINCT p, v AS q FROM r WHERE k = least(n - 1, CAST(floor(n * 0.9) AS BIGINT))")
def ag13(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderpriority").alias("p"), F.col("o_totalprice").alias("v"))
    return selection.nearest_rank(o, "p", "v", 0.9)


@query("ag14_median", "SELECT o_orderpriority AS p, round(median(o_totalprice), 4) AS m FROM orders GROUP BY 1")
def ag14(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderpriority").alias("p"), F.col("o_totalprice").alias("v"))
    return selection.median(o, "p", "v").select("p", F.round("median", 4).alias("m"))


@query("ag16_gap_threshold", f"WITH {EVENTS_SQL}, g AS (SELECT thread_id, ts - lag(ts) OVER (PARTITION BY thread_id ORDER BY ts, msg_id) AS gap FROM msgs) SELECT thread_id, round(least(43200.0, greatest(1800.0, avg(gap) + coalesce(stddev_samp(gap), 0))), 3) AS threshold FROM g GROUP BY 1 HAVING count(gap) > 0")
def ag16(spark, d):
    w = Window.partitionBy("thread_id").orderBy("ts", "msg_id")
    g = event_messages(spark, d).select("thread_id", (F.col("ts") - F.lag("ts").over(w)).alias("gap"))
    t = F.least(F.lit(43200.0), F.greatest(F.lit(1800.0), F.avg("gap") + F.coalesce(F.stddev_samp("gap"), F.lit(0.0))))
    return g.groupBy("thread_id").agg(F.round(t, 3).alias("threshold"), F.count("gap").alias("n")).filter("n > 0").drop("n")


@query("ag17_by_volume", f"WITH {EVENTS_SQL}, c AS (SELECT thread_id, author, count(*) AS n FROM msgs GROUP BY 1, 2) SELECT thread_id, string_agg(author || ':' || n, ',' ORDER BY n DESC, author) AS who FROM c GROUP BY 1")
def ag17(spark, d):
    c = event_messages(spark, d).groupBy("thread_id", "author").agg(F.count("*").alias("n"))
    lst = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "author", "n")))
    return c.groupBy("thread_id").agg(F.array_join(F.transform(lst, lambda s: F.concat(s["author"], F.lit(":"), s["n"].cast("string"))), ",").alias("who"))


@query("ag20_owner_share", f"WITH {EVENTS_SQL} SELECT thread_id, round(sum(CASE WHEN is_me THEN msg_id % 50 + 10 ELSE 0 END) / greatest(sum(msg_id % 50 + 10), 1), 3) AS share FROM msgs GROUP BY 1")
def ag20(spark, d):
    tok = F.col("msg_id") % 50 + 10
    return event_messages(spark, d).groupBy("thread_id").agg(F.round(F.sum(F.when(F.col("is_me"), tok).otherwise(0)) / F.greatest(F.sum(tok), F.lit(1)), 3).alias("share"))


@query("ag21_best_by_month", "SELECT strftime(o_orderdate, '%Y-%m') AS month, max_by(o_orderkey, (o_totalprice, -o_orderkey)) AS best, count(*) AS n FROM orders GROUP BY 1")
def ag21(spark, d):
    return read(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best"), F.count("*").alias("n"))


@query("ag23_dossier", f"WITH {EVENTS_SQL}, {ACCOUNTS_SQL} SELECT person_id, count(*) AS messages, CAST(sum(CAST(is_me AS INT)) AS BIGINT) AS by_you, CAST(sum(CAST(NOT is_me AS INT)) AS BIGINT) AS by_them, min({LOCAL_DAY}) AS first_day, max({LOCAL_DAY}) AS last_day, count(DISTINCT thread_id) AS chats FROM msgs JOIN accounts ON account_id = thread_id GROUP BY 1")
def ag23(spark, d):
    m = event_messages(spark, d).join(accounts(spark, d), F.col("account_id") == F.col("thread_id")).withColumn("day", times.local_day(F.col("ts")))
    return memory.dossier(m, "person_id")


@query("ag24_facet_buckets", f"WITH {INBOX_SQL} SELECT 'bucket' AS facet, bucket AS value, count(*) AS n FROM b WHERE owner = 'me' GROUP BY 2 UNION ALL SELECT 'area', area, count(*) FROM b WHERE owner = 'me' AND bucket = 'now' AND contains(lower(area || ' ' || cid), '1') GROUP BY 2 UNION ALL SELECT 'total', 'total', count(*) FROM b WHERE owner = 'me' AND bucket = 'now' AND contains(lower(area || ' ' || cid), '1') AND area = '1-URGENT'")
def ag24(spark, d):
    f = memory.facets(inbox(spark, d), owner="me", status="now", q="1", area="1-URGENT")
    b = f["buckets"].select(F.lit("bucket").alias("facet"), F.col("status").alias("value"), "n")
    return b.unionByName(f["areas"].select(F.lit("area").alias("facet"), F.col("area").alias("value"), "n")).unionByName(f["totals"].select(F.lit("total").alias("facet"), F.lit("total").alias("value"), F.col("total").alias("n")))


@query("ag26_precision_table", "SELECT toxic, count(*) AS n, CAST(count(*) FILTER (quality = 1) AS BIGINT) AS good, round(avg(quality), 4) AS share FROM labels GROUP BY 1")
def ag26(spark, d):
    return read(spark, d, "labels").groupBy("toxic").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.round(F.avg("quality"), 4).alias("share"))


@query("ag33_occurrences", "WITH k AS (SELECT doc_id, md5(text) AS h, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM documents) SELECT doc_id, k FROM k WHERE k > 1")
def ag33(spark, d):
    x = read(spark, d, "documents", "doc_id", "text").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    return x.withColumn("k", F.row_number().over(Window.partitionBy("h").orderBy("doc_id")).cast("long")).filter("k > 1").select("doc_id", "k")


@query("ag37_density", "SELECT conv_id, round(0.5 * least(avg(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) / 20.0, 1.0) + 0.3 * least(count(DISTINCT role) / 3.0, 1.0) + 0.2 * max(CASE WHEN contains(text, 'http') THEN 1 ELSE 0 END), 4) AS density FROM conversations GROUP BY 1")
def ag37(spark, d):
    n = F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    score = 0.5 * F.least(F.avg(n) / 20.0, F.lit(1.0)) + 0.3 * F.least(F.count_distinct("role") / 3.0, F.lit(1.0)) + 0.2 * F.max(F.when(F.col("text").contains("http"), 1).otherwise(0))
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.round(score, 4).alias("density"))


@query("ag38_rollup", "SELECT coalesce(l_returnflag, 'ALL') AS flag, coalesce(l_linestatus, 'ALL') AS status, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ag38(spark, d):
    r = read(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))
    return r.select(F.coalesce("l_returnflag", F.lit("ALL")).alias("flag"), F.coalesce("l_linestatus", F.lit("ALL")).alias("status"), "n", "qty")


# ---- sorts, limits, samples


@query("st03_top_threads", f"WITH {EVENTS_SQL} SELECT thread_id, count(*) AS n FROM msgs GROUP BY 1 ORDER BY n DESC, thread_id LIMIT 10")
def st03(spark, d):
    return event_messages(spark, d).groupBy("thread_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "thread_id").limit(10)


@query("st04_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def st04(spark, d):
    return read(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20).select("o_orderkey", "o_totalprice")


@query("st08_per_group", "SELECT o_custkey, o_orderkey, k FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def st08(spark, d):
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long")
    return read(spark, d, "orders").select("o_custkey", "o_orderkey", k.alias("k")).filter("k <= 3")


@query("st09_batches", "SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 6 AS batch FROM orders")
def st09(spark, d):
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return read(spark, d, "orders").select("o_custkey", "o_orderkey", F.floor((k - 1) / 6).cast("long").alias("batch"))


@query("st11_stratified", "WITH r AS (SELECT o_orderkey, o_orderpriority AS s, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR))) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n, count(*) OVER () AS total FROM orders) SELECT o_orderkey, s FROM r WHERE k <= greatest(25, round(200.0 * n / total))")
def st11(spark, d):
    """200 rows in proportion, 25 a stratum at least, in the order of a hash."""
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("s"))
    share = o.groupBy("s").agg(F.count("*").alias("n")).crossJoin(F.broadcast(o.agg(F.count("*").alias("total"))))  # strata x one row
    k = F.row_number().over(Window.partitionBy("s").orderBy(F.md5(F.col("o_orderkey").cast("string").cast("binary"))))
    return o.withColumn("k", k).join(share, "s").filter(F.col("k") <= F.greatest(F.lit(25), F.round(200.0 * F.col("n") / F.col("total")))).select("o_orderkey", "s")


# ---- set operations and writes


@query("so01_union", f"WITH {EVENTS_SQL} SELECT thread_id FROM msgs WHERE author = 'error' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def so01(spark, d):
    return event_messages(spark, d).filter("author = 'error'").select("thread_id").union(read(spark, d, "customer").filter("c_acctbal < 0").select("c_custkey")).distinct()


@query("so03_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def so03(spark, d):
    return read(spark, d, "documents", "doc_id").join(read(spark, d, "labels", "doc_id"), "doc_id", "left_anti")


@query("so05_changed_rows", "SELECT doc_id, n_chars AS before, length(replace(text, 'the ', '')) AS after FROM documents WHERE md5(text) <> md5(replace(text, 'the ', ''))")
def so05(spark, d):
    x = read(spark, d, "documents")
    new = x.select("doc_id", F.replace("text", F.lit("the "), F.lit("")).alias("t"))
    diff = tables.changed(x.select("doc_id", F.md5(F.col("text").cast("binary")).alias("h")), new.select("doc_id", F.md5(F.col("t").cast("binary")).alias("h")), "doc_id", "h")
    return diff.select("doc_id").join(x.select("doc_id", F.col("n_chars").alias("before")), "doc_id").join(new.select("doc_id", F.length("t").cast("long").alias("after")), "doc_id")


@query("so10_coverage", f"WITH {CHATS_SQL} SELECT count(*) AS total, count(*) FILTER (length(content) >= 40) AS kept, count(*) FILTER (length(content) < 40) AS skipped FROM chats")
def so10(spark, d):
    return chat_messages(spark, d).agg(F.count("*").alias("total"), F.count_if(F.length("content") >= 40).alias("kept"), F.count_if(F.length("content") < 40).alias("skipped"))


@query("so11_simple_edges", "SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_partkey <> l_suppkey")
def so11(spark, d):
    return graph.simple(read(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@query("sk01_insert_if_absent", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def sk01(spark, d):
    old = read(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return tables.inserted_if_absent(old, read(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"])


@query("sk02_placeholder_upgrade", "SELECT conv_id * 1000 + turn AS msg_id, CASE WHEN turn % 4 = 0 AND turn % 3 = 0 THEN text WHEN turn % 4 = 0 THEN '[Context Missing]' ELSE text END AS content FROM conversations")
def sk02(spark, d):
    c = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), F.col("text").alias("content"), "turn")
    old = c.select("msg_id", F.when(F.col("turn") % 4 == 0, "[Context Missing]").otherwise(F.col("content")).alias("content"))
    return tables.upgraded(old, c.filter("turn % 3 = 0").select("msg_id", "content"))


@query("sk03_surrogate_keys", "WITH k AS (SELECT DISTINCT c_mktsegment AS s FROM customer WHERE c_custkey <= 3), known AS (SELECT row_number() OVER (ORDER BY s) AS id, s FROM k), f AS (SELECT DISTINCT c_mktsegment AS s FROM customer WHERE c_mktsegment NOT IN (SELECT s FROM known)) SELECT id, s FROM known UNION ALL SELECT row_number() OVER (ORDER BY s) + (SELECT max(id) FROM known), s FROM f")
def sk03(spark, d):
    c = read(spark, d, "customer").select(F.col("c_mktsegment").alias("s"), "c_custkey")
    known = tables.with_keys(spark.createDataFrame([], "id long, s string"), c.filter("c_custkey <= 3"), ["s"])
    return tables.with_keys(known, c, ["s"])


@query("sk04_upsert", "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_mktsegment END AS v FROM customer")
def sk04(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("v"))
    return tables.upserted(c, c.filter("id % 4 = 0").select("id", F.lit("new").alias("v")), ["id"])


@query("sk05_changed_names", "SELECT c_custkey AS id, c_name AS before, CASE WHEN c_custkey % 9 = 0 THEN c_name || '!' ELSE c_name END AS after FROM customer WHERE c_custkey % 9 = 0")
def sk05(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    return tables.changed(c, c.withColumn("c_name", F.when(F.col("id") % 9 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name"))), "id", "c_name")


@query("sk07_quarantine", "SELECT doc_id, CASE WHEN toxic = 1 OR quality = 0 THEN 'dropped' ELSE 'kept' END AS place FROM labels")
def sk07(spark, d):
    kept, moved = tables.quarantined(read(spark, d, "labels"), (F.col("toxic") == 1) | (F.col("quality") == 0))
    return kept.select("doc_id", F.lit("kept").alias("place")).unionByName(moved.select("doc_id", F.lit("dropped").alias("place")))


@query("sk09_free_ids", "SELECT o_custkey || CASE WHEN k > 1 THEN '~' || k ELSE '' END AS id, o_orderkey FROM (SELECT CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)")
def sk09(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey")
    return tables.free_ids(o, "id", "o_orderkey")


@query("sk14_vector_merge", "SELECT vec_id, round(CASE WHEN vec_id % 2 = 0 THEN CAST(embedding[1] AS DOUBLE) * 2 ELSE CAST(embedding[1] AS DOUBLE) END, 6) AS first FROM embeddings")
def sk14(spark, d):
    e = read(spark, d, "embeddings", "vec_id", "embedding").withColumn("embedding", F.col("embedding").cast("array<double>"))
    fresh = e.filter("vec_id % 2 = 0").withColumn("embedding", F.transform("embedding", lambda x: x * 2))
    return tables.merged_vectors(e, fresh, e, "vec_id", "embedding").select("vec_id", F.round(F.element_at("embedding", 1), 6).alias("first"))


@query("ss04_multiset_append", "WITH s AS (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1), x AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer) SELECT c_custkey, c_nationkey FROM x LEFT JOIN s ON k = c_nationkey WHERE r > coalesce(n, 0)")
def ss04(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey")
    return tables.append_new(c.filter("c_custkey % 2 = 0"), c, ["c_nationkey"], ["c_custkey"])
