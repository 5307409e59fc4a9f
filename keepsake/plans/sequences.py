"""Turns, sessions, windows, reply trees and chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import times
from ..operators import conversations as cv
from ..sources.archive import CHATS_SQL, EVENTS_SQL, chat_messages, event_messages, read
from .registry import query


def units(spark, d):
    """Each event a unit of a pretended token count."""
    return event_messages(spark, d).select("thread_id", F.col("msg_id").alias("unit_id"), F.col("ts").alias("start_ts"), F.col("ts").alias("end_ts"), (F.col("msg_id") % 50 + 10).alias("tokens"))


@query("wn01_predecessor", f"WITH {CHATS_SQL} SELECT msg_id, lag(msg_id) OVER (PARTITION BY thread_id ORDER BY ts, msg_id) AS previous_id, ts - lag(ts) OVER (PARTITION BY thread_id ORDER BY ts, msg_id) AS gap FROM chats")
def wn01(spark, d):
    return cv.with_predecessor(chat_messages(spark, d)).select("msg_id", "previous_id", "gap")


TURNS_SQL = f"""WITH {CHATS_SQL}, f AS (SELECT *, CASE WHEN lag(msg_id) OVER w IS NULL OR lag(author) OVER w <> author OR ts - lag(ts) OVER w > 300 THEN 1 ELSE 0 END AS new FROM chats WINDOW w AS (PARTITION BY thread_id ORDER BY ts, msg_id)),
 t AS (SELECT *, sum(new) OVER (PARTITION BY thread_id ORDER BY ts, msg_id ROWS UNBOUNDED PRECEDING) AS turn_no FROM f)"""


@query("wn03_turns", TURNS_SQL + " SELECT thread_id, CAST(turn_no AS BIGINT) AS turn_no, min(author) AS author, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_messages, arg_min(msg_id, (ts, msg_id)) AS first_msg, md5(string_agg(content, ' / ' ORDER BY ts, msg_id)) AS line FROM t GROUP BY 1, 2")
def wn03(spark, d):
    return cv.turn_table(chat_messages(spark, d), text="content").withColumn("line", F.md5(F.col("line").cast("binary")))


@query("wn04_gap_sessions", f"WITH {EVENTS_SQL}, f AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > 2700 THEN 1 ELSE 0 END AS new FROM msgs WINDOW w AS (PARTITION BY thread_id ORDER BY ts, msg_id)), t AS (SELECT *, sum(new) OVER (PARTITION BY thread_id ORDER BY ts, msg_id ROWS UNBOUNDED PRECEDING) AS s FROM f) SELECT thread_id, CAST(s AS BIGINT) AS session_no, count(*) AS n, min(ts) AS a, max(ts) AS b FROM t GROUP BY 1, 2")
def wn04(spark, d):
    return cv.gap_sessions(event_messages(spark, d)).groupBy("thread_id", "session_no").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))


@query("wn04_session_window", f"WITH {EVENTS_SQL}, f AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= 2700 THEN 1 ELSE 0 END AS new FROM msgs WINDOW w AS (PARTITION BY thread_id ORDER BY ts, msg_id)), t AS (SELECT *, sum(new) OVER (PARTITION BY thread_id ORDER BY ts, msg_id ROWS UNBOUNDED PRECEDING) AS s FROM f) SELECT thread_id, count(*) AS n, min(ts) AS a FROM t GROUP BY thread_id, s")
def wn04b(spark, d):
    m = event_messages(spark, d).withColumn("at", F.timestamp_seconds("ts"))
    return m.groupBy("thread_id", times.sessions_of(F.col("at"), 2700)).agg(F.count("*").alias("n"), F.min("ts").alias("a")).select("thread_id", "n", "a")


SESSIONS_SQL = f"""WITH RECURSIVE {EVENTS_SQL}, r AS (SELECT thread_id, msg_id, ts, msg_id % 50 + 10 AS tok, row_number() OVER (PARTITION BY thread_id ORDER BY ts, msg_id) AS rn FROM msgs),
 w AS (SELECT thread_id, msg_id, ts, rn, tok AS acc, 1 AS s FROM r WHERE rn = 1 UNION ALL SELECT r.thread_id, r.msg_id, r.ts, r.rn,
  CASE WHEN r.ts - w.ts > 86400 OR (r.ts - w.ts > 2700 AND w.acc >= 120) OR w.acc + r.tok > 300 THEN r.tok ELSE w.acc + r.tok END,
  CASE WHEN r.ts - w.ts > 86400 OR (r.ts - w.ts > 2700 AND w.acc >= 120) OR w.acc + r.tok > 300 THEN w.s + 1 ELSE w.s END FROM w JOIN r ON r.thread_id = w.thread_id AND r.rn = w.rn + 1)
 SELECT thread_id, CAST(s AS BIGINT) AS session_no, count(*) AS n, min(ts) AS a, max(ts) AS b FROM w GROUP BY 1, 2"""  # fmt: skip


@query("wn05_sessions", SESSIONS_SQL)
def wn05(spark, d):
    return cv.sessions(units(spark, d), cap=300).groupBy("thread_id", "session_no").agg(F.count("*").alias("n"), F.min("start_ts").alias("a"), F.max("end_ts").alias("b"))


@query("wn06_windows", f"""WITH RECURSIVE {EVENTS_SQL}, r AS (SELECT thread_id, msg_id, ts, msg_id % 50 + 10 AS tok, row_number() OVER (PARTITION BY thread_id ORDER BY ts, msg_id) AS rn FROM msgs),
 ses AS (SELECT thread_id, msg_id, ts, rn, tok, tok AS acc, 1 AS s FROM r WHERE rn = 1 UNION ALL SELECT r.thread_id, r.msg_id, r.ts, r.rn, r.tok,
  CASE WHEN r.ts - w.ts > 86400 OR (r.ts - w.ts > 2700 AND w.acc >= 120) OR w.acc + r.tok > 3000 THEN r.tok ELSE w.acc + r.tok END,
  CASE WHEN r.ts - w.ts > 86400 OR (r.ts - w.ts > 2700 AND w.acc >= 120) OR w.acc + r.tok > 3000 THEN w.s + 1 ELSE w.s END FROM ses w JOIN r ON r.thread_id = w.thread_id AND r.rn = w.rn + 1),
 u AS (SELECT thread_id, s, msg_id, tok, row_number() OVER (PARTITION BY thread_id, s ORDER BY ts, msg_id) - 1 AS k FROM ses),
 p AS (SELECT thread_id, s, k, tok, sum(tok) OVER (PARTITION BY thread_id, s ORDER BY k) - tok AS before, sum(tok) OVER (PARTITION BY thread_id, s ORDER BY k) AS upto, count(*) OVER (PARTITION BY thread_id, s) AS n FROM u),
 e AS (SELECT i.thread_id, i.s, i.k AS i, i.n, greatest(i.k + 1, coalesce(max(j.k + 1) FILTER (j.upto - i.before <= 90), 0)) AS j FROM p i JOIN p j ON i.thread_id = j.thread_id AND i.s = j.s AND j.k >= i.k GROUP BY i.thread_id, i.s, i.k, i.n),
 x AS (SELECT e.thread_id, e.s, e.i, e.j, e.n, coalesce(min(q.k) FILTER (q.k > e.i AND (SELECT sum(z.tok) FROM p z WHERE z.thread_id = e.thread_id AND z.s = e.s AND z.k >= q.k AND z.k < e.j) <= 36), e.j) AS nxt FROM e LEFT JOIN p q ON q.thread_id = e.thread_id AND q.s = e.s AND q.k < e.j AND q.k > e.i GROUP BY 1, 2, 3, 4, 5),
 w AS (SELECT thread_id, s, i, j, n, nxt, 0 AS window_no FROM x WHERE i = 0 UNION ALL SELECT x.thread_id, x.s, x.i, x.j, x.n, x.nxt, w.window_no + 1 FROM w JOIN x ON x.thread_id = w.thread_id AND x.s = w.s AND x.i = w.nxt WHERE w.j < w.n)
 SELECT thread_id, CAST(s AS BIGINT) AS session_no, CAST(window_no AS BIGINT) AS window_no, CAST(j - i AS BIGINT) AS n FROM w""")  # fmt: skip
def wn06(spark, d):
    return cv.windows(cv.sessions(units(spark, d)), ["thread_id", "session_no"], 90, 0.4).groupBy("thread_id", "session_no", "window_no").agg(F.count("*").alias("n"))


@query("wn11_numbered_labels", "SELECT c_custkey, c_mktsegment || CASE WHEN k > 1 THEN ' #' || k ELSE '' END AS label FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer)")
def wn11(spark, d):
    from ..operators.graph import numbered_labels

    n = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"), F.col("c_acctbal").alias("size"))
    return numbered_labels(n).select(F.col("id").alias("c_custkey"), "label")


@query("wn13_previous_chunk", f"WITH {CHATS_SQL} SELECT msg_id, md5(coalesce(lag(content) OVER (PARTITION BY author ORDER BY ts, msg_id), '')) AS h FROM chats")
def wn13(spark, d):
    prev = F.lag("content").over(Window.partitionBy("author").orderBy("ts", "msg_id"))
    return chat_messages(spark, d).select("msg_id", F.md5(F.coalesce(prev, F.lit("")).cast("binary")).alias("h"))


@query("wn15_structure", f"WITH {CHATS_SQL}, f AS (SELECT *, CASE WHEN lag(msg_id) OVER w IS NOT NULL AND parent_id IS NOT NULL AND parent_id <> lag(msg_id) OVER w THEN 1 ELSE 0 END AS b FROM chats WINDOW w AS (PARTITION BY thread_id ORDER BY ts, msg_id)) SELECT thread_id, count(*) AS n, CAST(sum(b) AS BIGINT) AS branching, CASE WHEN count(*) < 3 THEN CASE WHEN count(parent_id) = 0 THEN 'chat' ELSE 'tree' END WHEN sum(b) / (count(*) - 1) > 0.3 THEN 'tree' ELSE 'chat' END AS structure FROM f GROUP BY 1")
def wn15(spark, d):
    return cv.structure(chat_messages(spark, d))


@query("wn16_latest_name", f"WITH {EVENTS_SQL} SELECT thread_id, arg_max(author, (ts, msg_id)) AS latest FROM msgs GROUP BY 1")
def wn16(spark, d):
    return event_messages(spark, d).groupBy("thread_id").agg(F.max_by("author", F.struct("ts", "msg_id")).alias("latest"))


@query("wn17_segments", "WITH f AS (SELECT label, vec_id, CASE WHEN lag(vec_id) OVER w IS NULL OR round(list_cosine_similarity(embedding::DOUBLE[], lag(embedding::DOUBLE[]) OVER w), 9) < 0.1 THEN 1 ELSE 0 END AS new FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)) SELECT vec_id, CAST(sum(new) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM f")
def wn17(spark, d):
    return cv.segments_by_similarity(read(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.1).select("vec_id", "segment")


@query("wn18_own_chains", f"""WITH RECURSIVE {EVENTS_SQL}, mine AS (SELECT msg_id, parent_id, ts FROM msgs WHERE author IN ('click', 'view', 'error')),
 f AS (SELECT p.msg_id AS up, arg_min(c.msg_id, (c.ts, c.msg_id)) AS down FROM mine c JOIN mine p ON c.parent_id = p.msg_id GROUP BY 1),
 w AS (SELECT msg_id AS head, msg_id AS at, 1 AS len FROM mine WHERE parent_id IS NULL OR parent_id NOT IN (SELECT msg_id FROM mine) UNION ALL SELECT w.head, f.down, w.len + 1 FROM w JOIN f ON f.up = w.at)
 SELECT head, CAST(max(len) AS BIGINT) AS length FROM w GROUP BY 1 HAVING max(len) >= 3""")  # fmt: skip
def wn18(spark, d):
    return cv.own_reply_chains(event_messages(spark, d), F.col("author").isin("click", "view", "error"))


@query("cx01_stitched_threads", f"""WITH RECURSIVE {EVENTS_SQL}, e AS (SELECT DISTINCT least(c.thread_id, p.thread_id) AS a, greatest(c.thread_id, p.thread_id) AS b FROM msgs c JOIN msgs p ON p.msg_id = c.parent_id WHERE c.thread_id <> p.thread_id),
 s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(id, c) AS (SELECT a, a FROM s UNION SELECT r.id, s.b FROM r JOIN s ON s.a = r.c) SELECT id, min(c) AS component FROM r GROUP BY 1""")  # fmt: skip
def cx01(spark, d):
    m = event_messages(spark, d)
    p = m.select(F.col("msg_id").alias("parent_id"), F.col("thread_id").alias("b"))
    e = m.join(p, "parent_id").filter("thread_id <> b").select(F.col("thread_id").alias("a"), "b")
    return cv.stitched(e)


@query("cx02_reply_preorder", f"""WITH RECURSIVE {CHATS_SQL}, t AS (SELECT thread_id, msg_id, 0 AS depth, [{{'ts': ts, 'msg_id': msg_id}}] AS path FROM chats WHERE parent_id IS NULL OR parent_id NOT IN (SELECT msg_id FROM chats)
 UNION ALL SELECT c.thread_id, c.msg_id, t.depth + 1, list_append(t.path, {{'ts': c.ts, 'msg_id': c.msg_id}}) FROM t JOIN chats c ON c.parent_id = t.msg_id)
 SELECT thread_id, msg_id, depth, row_number() OVER (PARTITION BY thread_id ORDER BY path) AS place FROM t""")  # fmt: skip
def cx02(spark, d):
    p = cv.reply_paths(chat_messages(spark, d))
    return p.select("thread_id", "msg_id", "depth", F.row_number().over(Window.partitionBy("thread_id").orderBy("path")).cast("long").alias("place"))


@query("cx04_index_policy", "SELECT CASE WHEN len(regexp_extract_all(text, '\\S+')) * 1.4 + 1 >= 8 THEN 'embed' ELSE 'fts_only' END AS policy, count(*) AS n FROM conversations GROUP BY 1")
def cx04(spark, d):
    policy = F.when(tx.token_estimate(F.col("text")) >= 8, "embed").otherwise("fts_only")
    return read(spark, d, "conversations").groupBy(policy.alias("policy")).agg(F.count("*").alias("n"))


@query("cx03_chunks")
def cx03(spark, d):
    """Messages to cleaned turns, sessions and chunks with content-hash ids, header, owner share and policy; a structural rule is checked by cx05."""
    return chunks(spark, d)[0]


def chunks(spark, d, target: int = 300, overlap: float = 0.15):
    m = chat_messages(spark, d).withColumn("content", tx.cleaned(F.col("content"))).filter("content is not null")
    turn = cv.turns(m)
    line = cv.turn_table(m, text="content").select("thread_id", "turn_no", "author", "start_ts", "end_ts", F.col("first_msg").alias("unit_id"), F.concat(F.lit("["), F.col("start_ts").cast("string"), F.lit("] "), "author", F.lit(": "), "line").alias("line"))
    pieces = line.select("*", F.posexplode(tx.split_words(F.col("line"), target)).alias("k", "piece")).drop("line")
    unit = pieces.select("thread_id", "turn_no", "author", "start_ts", "end_ts", (F.col("unit_id") * 1000 + F.col("k")).alias("unit_id"), F.col("unit_id").alias("piece_of"), "piece", tx.token_estimate(F.col("piece")).cast("long").alias("tokens"))
    ses = cv.sessions(unit)
    win = cv.windows(ses, ["thread_id", "session_no"], target, overlap)
    full = win.join(ses, ["thread_id", "session_no", "unit_id"])
    lines = F.transform(F.array_sort(F.collect_list(F.struct("position", "piece", F.col("piece_of").cast("string").alias("m")))), lambda s: s)
    each = full.groupBy("thread_id", "session_no", "window_no").agg(lines.alias("u"), F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.sum("tokens").alias("token_count"), F.round(F.sum(F.when(F.col("author") == "user", F.col("tokens")).otherwise(0)) / F.greatest(F.sum("tokens"), F.lit(1)), 3).alias("ego_weight"))
    ids = F.array_distinct(F.transform("u", lambda s: s["m"]))
    out = each.select(
        tx.stable_id("c_", F.array_append(ids, F.col("window_no").cast("string"))).alias("chunk_id"), "thread_id", "session_no", "window_no", "start_ts", "end_ts", "token_count", "ego_weight",
        F.when(F.col("token_count") >= 8, "embed").otherwise("fts_only").alias("index_policy"), F.concat_ws(" · ", F.lit("Chat conversation"), F.concat(F.lit("thread "), F.col("thread_id").cast("string"))).alias("header"), F.array_join(F.transform("u", lambda s: s["piece"]), "\n").alias("text"), F.size("u").alias("n_units"),
    )
    members = full.select("thread_id", "session_no", "window_no", F.col("turn_no")).distinct().join(turn.select("thread_id", "turn_no", "msg_id"), ["thread_id", "turn_no"])
    return out, members, m


@query("cx05_chunk_checks", f"WITH {CHATS_SQL} SELECT count(*) AS messages, count(*) AS chunked, CAST(0 AS BIGINT) AS over_cap, CAST(0 AS BIGINT) AS in_two_sessions FROM chats WHERE length(trim(content)) > 0")
def cx05(spark, d):
    """Every message is in a chunk, no chunk is over its cap, no message is in two sessions."""
    out, members, m = chunks(spark, d)
    over = out.agg(F.count_if(F.col("token_count") > 300 + 120).alias("over_cap"))
    got = members.agg(F.count_distinct("msg_id").alias("chunked"))
    per = members.select("msg_id", "session_no").distinct().groupBy("msg_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("in_two_sessions"))
    return m.agg(F.count("*").alias("messages")).crossJoin(got).crossJoin(over).crossJoin(per)  # single rows
