"""Read endpoints, tools, statements in SQL, and the stages around model calls."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import times
from ..functions.vectors import cosine, literal
from ..operators import conversations as cv
from ..operators import enrich, graph, identity, memory, retrieval
from ..operators import tables as tb
from ..sources import tables, views
from ..sources.archive import CHATS_SQL, EVENTS_SQL, chat_messages, event_messages, read
from .registry import query
from .search import ASKED, ASKED_VECTOR, bm25_sql, keyword_leg, vector_of
from .sequences import TURNS_SQL

MD5 = lambda c: F.md5(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).cast("binary"))
ASKED_SQL = f"(SELECT embedding FROM embeddings WHERE vec_id = {ASKED_VECTOR})"


def asked(spark, d):
    return literal(vector_of(spark, d, ASKED_VECTOR))


# --- statements in SQL


@query("ud01_sql_functions", "SELECT user_id AS thread_id, strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d') AS day, event_type AS who, (((event_id * 6000000001 + 20000000000000) >> 22) + 1288834974657) // 1000 AS at FROM events")
def ud01(spark, d):
    views.register(spark, d)
    return spark.sql("SELECT thread_id, local_day(ts) AS day, name_key(concat('@', author)) AS who, id_time(msg_id * 6000000001 + 20000000000000) AS at FROM messages")


@query("ud02_sql_over_views", "SELECT n_name AS name, count(*) AS n, count(DISTINCT c_custkey) AS accounts FROM events JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey WHERE event_type <> 'error' GROUP BY 1")
def ud02(spark, d):
    views.register(spark, d)
    return views.select(spark, "SELECT p.name, count(*) AS n, count(DISTINCT a.account_id) AS accounts FROM messages m JOIN accounts a ON a.account_id = m.thread_id JOIN people p USING (person_id) WHERE m.author <> 'error' GROUP BY 1;")


STATEMENTS = [("SELECT 1", True), ("with x as (select 1) select * from x;", True), ("select 'drop table t; delete' as s", True), ("select 1; select 2", False), ("drop table t", False), ("with x as (select 1) insert into t select * from x", False), ("-- select\ndelete from t", False), ("select java_method('java.lang.System', 'exit', 0)", False), ("", False), ("select a from t where note = 'it''s; set' -- set\n", True)]


@query("pf24_select_only", "SELECT c_custkey AS k, c_custkey % 10 IN (0, 1, 2, 9) AS allowed FROM customer")
def pf24(spark, d):
    """Which statements of a log only read: ten forms, about every account."""
    forms = F.array(*(F.lit(s) for s, _ in STATEMENTS))
    log = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.get(forms, (F.col("c_custkey") % 10).cast("int")), F.lit(" -- about "), "c_name").alias("statement"))
    return log.select("k", views.only_reads(F.col("statement")).alias("allowed"))


@query("ud03_table_valued", "SELECT event_type, sum(v) AS total FROM (SELECT event_type, unnest([event_id, event_id * 2]) AS v FROM events) GROUP BY 1")
def ud03(spark, d):
    read(spark, d, "events").select("event_type", F.to_json(F.array(F.col("event_id"), F.col("event_id") * 2)).alias("j")).createOrReplaceTempView("event_lists")
    return spark.sql("SELECT event_type, CAST(sum(v) AS DECIMAL(38, 0)) AS total FROM event_lists, LATERAL explode(from_json(j, 'array<bigint>')) AS t(v) GROUP BY 1")


@query("ud03_turns_function", TURNS_SQL + " SELECT author, count(*) AS turns, CAST(sum(n) AS BIGINT) AS messages, CAST(sum(first) AS BIGINT) AS firsts FROM (SELECT thread_id, turn_no, min(author) AS author, count(*) AS n, arg_min(msg_id, (ts, msg_id)) AS first FROM t GROUP BY 1, 2) GROUP BY 1")
def ud03_turns(spark, d):
    """A table function with state, asked in SQL: it takes a table and brings it by thread and in order itself."""
    tables.register(spark)
    chat_messages(spark, d).createOrReplaceTempView("chat_log")
    return spark.sql("SELECT author, count(*) AS turns, CAST(sum(n_messages) AS BIGINT) AS messages, CAST(sum(first_msg) AS BIGINT) AS firsts FROM turns(TABLE(chat_log), 300) GROUP BY author")


@query("ud04_row_functions", "SELECT doc_id, md5(strip_accents(lower(coalesce(lang, '?')))) AS h, length(coalesce(text, '')) AS n FROM documents")
def ud04(spark, d):
    """A function of rows in Python, over Arrow batches; for what has no expression."""
    @F.pandas_udf("long")
    def size(t: pd.Series) -> pd.Series:
        return t.fillna("").str.len()

    return read(spark, d, "documents").select("doc_id", MD5(tx.unaccented(F.lower(F.coalesce("lang", F.lit("?"))))).alias("h"), size("text").alias("n"))


@query("qt08_cited_rows", f"WITH {EVENTS_SQL}, r AS (SELECT msg_id, author FROM msgs WHERE author = 'click' ORDER BY ts, msg_id LIMIT 25) SELECT msg_id, author, CASE WHEN msg_id % 2 = 0 THEN 'c' || lpad(CAST(msg_id // 10 AS VARCHAR), 6, '0') END AS chunk FROM r")
def qt08(spark, d):
    """The first 25 rows of a statement; those that carry a message cite its first chunk."""
    views.register(spark, d)
    rows = views.select(spark, "SELECT msg_id, author FROM messages WHERE author = 'click' ORDER BY ts, msg_id", limit=25, deadline=600.0)
    m = event_messages(spark, d).filter("msg_id % 2 = 0").select("msg_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    chunks = m.select("msg_id", F.concat(F.lit("c"), F.lpad((F.floor(F.col("msg_id") / 10) + F.col("k") * 500_000).cast("string"), 6, "0")).alias("chunk"))
    return rows.join(retrieval.first_chunks(chunks), "msg_id", "left")


# --- search and recall


@query("rt07_reranked", f"WITH {bm25_sql()} SELECT doc_id AS doc, CAST(length(text) AS DOUBLE) AS score, row_number() OVER (ORDER BY length(text) DESC, doc_id) AS rank FROM (SELECT doc_id FROM kr WHERE rank <= 30) JOIN documents USING (doc_id) ORDER BY rank LIMIT 10")
def rt07(spark, d):
    """A pool of 30 ordered by a model; the one given here scores by length."""
    texts = read(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    return retrieval.reranked(keyword_leg(spark, d, None, 30), texts, lambda ts: [float(len(t)) for t in ts], 10)


@query("ud05_pluggable_models", f"WITH {bm25_sql()} SELECT doc_id AS doc, CAST(-length(text) AS DOUBLE) AS score, row_number() OVER (ORDER BY length(text), doc_id) AS rank FROM (SELECT doc_id FROM kr WHERE rank <= 50) JOIN documents USING (doc_id) ORDER BY rank LIMIT 5")
def ud05(spark, d):
    texts = read(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    return retrieval.reranked(keyword_leg(spark, d), texts, lambda ts: [-float(len(t)) for t in ts], 5)


@query("rt08_degrades_to_keywords", f"WITH {bm25_sql()} SELECT doc_id AS doc, score, rank FROM kr WHERE rank <= 50")
def rt08(spark, d):
    """The encoder is away: the search goes by keywords alone."""

    def encode(texts):
        raise OSError("no encoder")

    vectors = retrieval.QueryVectors(encode)
    vectors.prefetch([ASKED])
    legs = retrieval.legs(vectors, ASKED, lambda v: None, lambda: keyword_leg(spark, d))
    return legs[0] if len(legs) == 1 else legs[0].limit(0)


RECALL = f"WITH f AS (SELECT vec_id AS fact, label AS entity, embedding, CASE WHEN vec_id % 4 = 0 THEN 'past' ELSE 'current' END AS status FROM embeddings), s AS (SELECT fact, status, round(list_cosine_similarity(embedding::DOUBLE[], {ASKED_SQL}::DOUBLE[]), 6) AS score FROM f WHERE entity IN (1, 3, 7) AND fact % 5 <> 0 AND status = 'current')"


def facts(spark, d):
    e = read(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("fact"), F.col("label").alias("entity"), F.col("embedding").alias("vec"), F.when(F.col("vec_id") % 4 == 0, "past").otherwise("current").alias("status"))


@query("rt11_fact_recall", RECALL + " SELECT fact, score, row_number() OVER (ORDER BY score DESC, fact) AS rank FROM s ORDER BY rank LIMIT 20")
def rt11(spark, d):
    f = facts(spark, d)
    rejected = f.filter("fact % 5 = 0").select("fact")
    return memory.recalled(f, rejected, [1, 3, 7], asked(spark, d), past=False, k=20).select("fact", "score", "rank")


@query("rt11_recall_without_vector", "WITH f AS (SELECT vec_id AS fact, vec_id % 4 = 0 AS past FROM embeddings WHERE label IN (1, 3, 7) AND vec_id % 5 <> 0) SELECT fact, row_number() OVER (ORDER BY past, fact) AS rank FROM f ORDER BY rank LIMIT 20")
def rt11b(spark, d):
    f = facts(spark, d)
    return memory.recalled(f, f.filter("fact % 5 = 0").select("fact"), [1, 3, 7], None, past=True, k=20).select("fact", "rank")


@query("qt01_recall", RECALL + " SELECT '[' || row_number() OVER (ORDER BY score DESC, fact) || '] fact ' || fact || ' (' || status || ')' AS line FROM s ORDER BY score DESC, fact LIMIT 20")
def qt01(spark, d):
    f = facts(spark, d)
    r = memory.recalled(f, f.filter("fact % 5 = 0").select("fact"), [1, 3, 7], asked(spark, d), past=False, k=20)
    return r.select(F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] fact "), F.col("fact").cast("string"), F.lit(" ("), "status", F.lit(")")).alias("line"))


@query("rt13_embedding_batches", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0.0 ELSE round(length(coalesce(text, '')) / sqrt(length(coalesce(text, '')) * length(coalesce(text, '')) + 1.0), 6) END AS x, CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE round(1 / sqrt(length(coalesce(text, '')) * length(coalesce(text, '')) + 1.0), 6) END AS y FROM documents")
def rt13(spark, d):
    """Vectors of texts that have none yet, in batches of like length, at length one; a third is reused."""
    doc = read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    old = doc.filter("doc_id % 3 = 0").select("doc_id", F.array(F.lit(0.0), F.lit(1.0)).alias("vec"))
    v = enrich.embedded(doc, old, "doc_id", "text", lambda ts: [[float(len(t)), 1.0] for t in ts])
    return v.select("doc_id", F.round(F.col("vec")[0], 6).alias("x"), F.round(F.col("vec")[1], 6).alias("y"))


# --- themes and layout


THEME_TOPICS = "t AS (SELECT p_type AS scope, p_brand AS theme, p_partkey AS item, unnest(list_distinct(string_split(p_name, ' '))) AS topic FROM part)"


def theme_topics(spark, d):
    return read(spark, d, "part").select(F.col("p_type").alias("scope"), F.col("p_brand").alias("theme"), F.col("p_partkey").alias("item"), F.explode(F.array_distinct(F.split("p_name", " "))).alias("topic"))


@query("cl02_theme_names", f"""WITH RECURSIVE {THEME_TOPICS}, z AS (SELECT scope, theme, count(DISTINCT item) AS n_in FROM t GROUP BY 1, 2), a AS (SELECT scope, count(DISTINCT item) AS n_all FROM t GROUP BY 1),
 g AS (SELECT scope, theme, n_in, n_all, row_number() OVER (PARTITION BY scope ORDER BY n_in DESC, theme) AS turn FROM z JOIN a USING (scope) WHERE n_in >= 2 AND n_in >= 0.02 * n_all),
 i AS (SELECT scope, theme, topic, count(DISTINCT item) AS c_in FROM t GROUP BY 1, 2, 3), o AS (SELECT scope, topic, count(DISTINCT item) AS c_all FROM t GROUP BY 1, 2),
 s AS (SELECT scope, theme, topic, round(c_in / n_in * ln((c_in / n_in + 0.01) / (CASE WHEN n_all > n_in THEN (c_all - c_in) / (n_all - n_in) ELSE 0 END + 0.01)), 9) AS score FROM g JOIN i USING (scope, theme) JOIN o USING (scope, topic) WHERE c_in >= least(2, n_in)),
 l AS (SELECT g.scope, g.theme, g.turn, coalesce(list(topic ORDER BY score DESC, topic) FILTER (score > 0), []) AS topics FROM g LEFT JOIN s USING (scope, theme) GROUP BY 1, 2, 3),
 w AS (SELECT scope, theme, turn, topics[1:3] AS names, topics[1:3] AS used FROM l WHERE turn = 1
 UNION ALL SELECT scope, theme, turn, names, list_concat(used, names) AS used FROM (SELECT l.scope, l.theme, l.turn, w.used, list_filter(l.topics, lambda x: NOT list_contains(w.used, x))[1:3] AS names FROM w JOIN l ON l.scope = w.scope AND l.turn = w.turn + 1))
SELECT scope, theme, array_to_string(names, ', ') AS names FROM w WHERE len(names) > 0""")  # fmt: skip
def cl02(spark, d):
    return memory.theme_names(theme_topics(spark, d)).select("scope", "theme", F.array_join("names", ", ").alias("names"))


@query("cl03_where_and_when", "WITH x AS (SELECT c_nationkey AS theme, o_orderpriority AS place, o_orderdate FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 5 < 3), n AS (SELECT theme, place, count(*) AS n FROM (SELECT theme, CASE WHEN theme % 2 = 0 AND place <> '5-LOW' THEN '1-URGENT' ELSE place END AS place FROM x) GROUP BY 1, 2), m AS (SELECT theme, arg_max(place, (n, -ascii(place))) AS place, max(n) / sum(n) AS share FROM n GROUP BY 1), s AS (SELECT theme, min(o_orderdate) AS a, max(o_orderdate) AS b FROM x GROUP BY 1) SELECT theme, CASE WHEN share >= 0.5 THEN place END AS mostly, CASE WHEN strftime(a, '%b %Y') = strftime(b, '%b %Y') THEN strftime(a, '%b %Y') WHEN year(a) = year(b) THEN strftime(a, '%b') || ' – ' || strftime(b, '%b %Y') ELSE strftime(a, '%b %Y') || ' – ' || strftime(b, '%b %Y') END AS span FROM m JOIN s USING (theme)")
def cl03(spark, d):
    o = read(spark, d, "orders").filter("o_orderkey % 5 < 3").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    place = F.when((F.col("c_nationkey") % 2 == 0) & (F.col("o_orderpriority") != "5-LOW"), "1-URGENT").otherwise(F.col("o_orderpriority"))
    return memory.where_and_when(o.select(F.col("c_nationkey").alias("theme"), place.alias("place"), times.epoch(F.col("o_orderdate")).alias("ts")), 0)


@query("gr04_galaxy", "WITH p AS (SELECT c_custkey AS id, c_mktsegment AS bucket, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) - 1 AS k FROM customer), b AS (SELECT bucket, row_number() OVER (ORDER BY bucket) - 1 AS j, count(*) OVER () AS n FROM (SELECT DISTINCT bucket FROM p)) SELECT id, round(300 * cos(2 * pi() * j / n) + 4 * sqrt(k) * cos(k * 2.399963229728653), 6) AS x, round(300 * sin(2 * pi() * j / n) + 4 * sqrt(k) * sin(k * 2.399963229728653), 6) AS y FROM p JOIN b USING (bucket)")
def gr04(spark, d):
    n = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("bucket"), F.col("c_acctbal").alias("size"))
    return graph.galaxy(n).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


# --- around model calls


SESSIONS_SQL = f"{CHATS_SQL}, s AS (SELECT thread_id AS session, min(ts) AS start_ts, string_agg(author || ': ' || content, chr(10) ORDER BY ts, msg_id) AS body FROM chats GROUP BY 1)"


def sessions(spark, d):
    m = chat_messages(spark, d)
    lines = F.array_sort(F.collect_list(F.struct("ts", "msg_id", F.concat("author", F.lit(": "), "content").alias("l"))))
    return m.groupBy(F.col("thread_id").alias("session")).agg(F.min("ts").alias("start_ts"), F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias("body"))


@query("en01_summary_prompts", f"WITH {SESSIONS_SQL} SELECT session, md5('Before:' || chr(10) || coalesce(lag(body) OVER w, '-') || chr(10) || 'Session:' || chr(10) || body || chr(10) || 'After:' || chr(10) || coalesce(lead(body) OVER w, '-')) AS h FROM s WINDOW w AS (PARTITION BY session % 5 ORDER BY start_ts, session)")
def en01(spark, d):
    """Each session with its neighbours in the chat, which are only to be read."""
    return enrich.prompts(sessions(spark, d).withColumn("chat", F.col("session") % 5), "chat").select("session", MD5("prompt").alias("h"))


@query("en02_raw_facts", "WITH f AS (SELECT o_orderkey AS session, (row_number() OVER (ORDER BY o_orderkey) - 1) // 6 AS call, 'buys ' || o_orderpriority AS statement FROM orders WHERE o_orderkey % 10 = 0) SELECT session, call, statement, 'f_' || substr(sha1(session || '|' || statement), 1, 16) AS fact_id FROM f WHERE session % 3 <> 0")
def en02(spark, d):
    """Six sessions a call; what isn't a fact of a known kind is dropped. The model here answers by rule."""
    o = read(spark, d, "orders").filter("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("session"), F.col("o_orderpriority").alias("text"))

    def model(sessions_, texts):
        import json

        return [json.dumps([{"subject": "me", "kind": "habit" if s % 3 else "rumour", "category": "shop", "statement": f"buys {t}"}, {"subject": "me"}]) for s, t in zip(sessions_, texts, strict=True)]

    return enrich.raw_facts(o, "session", "text", model, per_call=6).select("session", "call", "statement", "fact_id")


@query("en03_linked_entities", "SELECT o_orderkey AS fact, CASE o_orderkey % 3 WHEN 0 THEN 'self' WHEN 1 THEN 'account' ELSE 'thing' END AS kind, CASE o_orderkey % 3 WHEN 1 THEN o_custkey END AS account_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def en03(spark, d):
    o = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey") % 3
    f = o.select(F.col("o_orderkey").alias("fact"), (F.col("o_custkey") % 10).alias("scope"), F.when(k == 0, "I").when(k == 1, F.upper("c_name")).otherwise("the house").alias("subject"))
    who = read(spark, d, "customer").select((F.col("c_custkey") % 10).alias("scope"), F.col("c_custkey").alias("account_id"), F.col("c_name").alias("name"))
    return enrich.linked(f, who)


@query("en04_consolidated", "WITH g AS (SELECT o_custkey AS entity, o_orderpriority AS cluster, count(*) AS n, arg_max('s' || o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY 1, 2) SELECT entity, cluster, n, CASE WHEN n = 1 THEN latest WHEN entity % 2 = 0 THEN 'merged ' || n ELSE latest END AS statement FROM g")
def en04(spark, d):
    """Single facts pass; groups get the model's sentence, or where it gave none their latest."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("cluster"), F.col("o_orderkey").alias("id"), F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("statement"), F.col("o_orderdate").alias("said_on"))
    merged = o.groupBy("entity", "cluster").agg(F.concat(F.lit("merged "), F.count("*").cast("string")).alias("merged")).filter("entity % 2 = 0")
    return enrich.consolidated(o, merged)


@query("en05_reconciled", "WITH g AS (SELECT o_custkey AS entity, count(DISTINCT o_orderpriority) AS support FROM orders GROUP BY 1 HAVING count(*) > 2) SELECT entity, support, (row_number() OVER (ORDER BY entity) - 1) // 10 AS call FROM g")
def en05(spark, d):
    """Groups of look-alikes, ten a call, with how many sessions bear them out."""
    g = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(F.count_distinct("o_orderpriority").alias("support"), F.count("*").alias("n")).filter("n > 2")
    return enrich.in_calls(g.select("entity", "support"), "entity", 10)


@query("en06_verified", "WITH p AS (SELECT a.vec_id AS fact, b.vec_id AS evidence, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) AS k FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id % 3 = 0 WHERE a.vec_id % 3 <> 0) SELECT fact, list(evidence ORDER BY k) AS evidence, CASE WHEN fact % 4 = 0 THEN 'quarantined' WHEN fact % 4 = 1 THEN 'corrected' ELSE 'kept' END AS state FROM p WHERE k <= 3 GROUP BY 1")
def en06(spark, d):
    """Each fact against its three nearest pieces of evidence; what is wrong goes aside, what is partly right is corrected and loses its vector."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("entity"), F.col("embedding").alias("vec"))
    near = enrich.evidence(e.filter("id % 3 <> 0"), e.filter("id % 3 = 0"), 3)
    verdict = F.when(F.col("fact") % 4 == 0, "wrong").when(F.col("fact") % 4 == 1, "partly").otherwise("right")
    return near.select("fact", "evidence", enrich.after_verdict(verdict).alias("state"))


@query("en07_fresh_facts", "WITH f AS (SELECT o_custkey AS fact, max(CAST(o_orderdate AS DATE)) AS seen FROM orders GROUP BY 1) SELECT fact, CAST(seen AS VARCHAR) AS last_seen, CASE WHEN fact % 2 = 0 AND seen < DATE '2001-06-01' - INTERVAL 45 DAY THEN 'past' ELSE 'current' END AS status, fact % 2 = 1 AND seen < DATE '2001-06-01' - INTERVAL 180 DAY AS stale FROM f")
def en07(spark, d):
    """When the evidence of a fact was last seen, and what that makes of it."""
    f = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("fact")).agg(F.max(F.to_date("o_orderdate")).alias("seen"))
    durability = F.when(F.col("fact") % 2 == 0, "transient").otherwise("state")
    status, stale = times.fact_freshness(durability, F.lit("current"), F.col("seen"), F.lit("2001-06-01"))
    return f.select("fact", F.col("seen").cast("string").alias("last_seen"), status.alias("status"), stale.alias("stale"))


@query("en08_corrections", "SELECT o_orderkey AS fact, CASE WHEN o_orderkey % 7 = 1 THEN 'user: ' || o_orderpriority ELSE o_orderpriority END AS text FROM orders WHERE o_orderkey % 7 <> 0")
def en08(spark, d):
    """After a rebuild what the user has refused goes again, and what they have put right is put right again."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("fact"), F.col("o_orderpriority").alias("text"))
    said = o.filter("fact % 7 in (0, 1)").select("fact", F.when(F.col("fact") % 7 == 0, "wrong").otherwise("edited").alias("verdict"), F.concat(F.lit("user: "), "text").alias("correction"))
    return enrich.corrected(o, said)


@query("en09_commitments", "WITH c AS (SELECT o_orderkey AS session, k, 'do ' || k AS what, CASE WHEN k = 2 THEN '2024-02-30' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS due FROM orders, (SELECT unnest([0, 1, 2]) AS k) WHERE o_orderkey % 6 = 0) SELECT session, what, CASE WHEN k % 2 = 0 THEN 'me' ELSE 'them' END AS owner, try_cast(due AS DATE) AS due, (row_number() OVER (ORDER BY session, what) - 1) // 40 AS call FROM c")
def en09(spark, d):
    """Commitments named in summaries, forty a call; a date that isn't one is none."""
    o = read(spark, d, "orders").filter("o_orderkey % 6 = 0")
    item = lambda k, who: F.struct(F.lit(f"do {k}").alias("what"), F.lit(who).alias("owner"), (F.lit("2024-02-30") if k == 2 else F.date_format("o_orderdate", "yyyy-MM-dd")).alias("due"))
    j = F.to_json(F.struct(F.array(item(0, "me"), item(1, "them"), item(2, "me"), F.struct(F.lit(None).cast("string").alias("what"), F.lit("me").alias("owner"), F.lit(None).cast("string").alias("due"))).alias("commitments")))
    return enrich.commitments(o.select(F.col("o_orderkey").alias("session"), j.alias("summary")), 40)


@query("en10_triage_context", f"WITH {SESSIONS_SQL}, n AS (SELECT session, body, lead(session) OVER w AS n1, lead(session, 2) OVER w AS n2 FROM s WINDOW w AS (PARTITION BY session % 5 ORDER BY start_ts, session)) SELECT session, md5(body) AS h, n1, n2 FROM n WHERE session % 2 = 0")
def en10(spark, d):
    """Current items with their session's text and the two sessions after it."""
    w = Window.partitionBy("chat").orderBy("start_ts", "session")
    s = sessions(spark, d).withColumn("chat", F.col("session") % 5).select("session", MD5("body").alias("h"), F.lead("session", 1).over(w).alias("n1"), F.lead("session", 2).over(w).alias("n2"))
    items = sessions(spark, d).filter("session % 2 = 0").select("session")
    return s.join(items, "session", "left_semi")


@query("en11_area_batches", "WITH i AS (SELECT o_orderkey AS item, o_custkey AS account FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 8 <> 0) SELECT item, (row_number() OVER (ORDER BY item) - 1) // 25 AS call, CASE WHEN account % 3 = 0 THEN 'note ' || account END AS notes FROM i")
def en11(spark, d):
    """Items without an area, 25 a call, with the notes about their people."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("account"))
    done = o.filter("item % 8 = 0").select("item")
    notes = o.select("account").distinct().filter("account % 3 = 0").select("account", F.concat(F.lit("note "), F.col("account").cast("string")).alias("notes"))
    rows = o.filter("item % 4 = 0").join(done, "item", "left_anti").join(notes, "account", "left")
    return enrich.in_calls(rows.select("item", "notes"), "item", 25)


@query("en12_name_guesses", "SELECT c_custkey AS account, c_name AS guess, c_custkey % 3 = 0 AS sure FROM customer WHERE c_custkey % 2 = 0")
def en12(spark, d):
    """A model's guess of a name counts once a message says it."""
    k = F.col("c_custkey")
    c = read(spark, d, "customer").filter("c_custkey % 2 = 0")
    said = F.when(k % 3 == 0, F.concat(F.lit("hello "), F.lower("c_name"))).otherwise(F.concat(F.lit("who is "), "c_name"))
    m = c.select(k.alias("account"), F.explode(F.array(F.lit("?"), said)).alias("text"))
    return enrich.checked_names(c.select(k.alias("account"), F.col("c_name").alias("guess")), m)


@query("en13_audit", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey || '-1'), o_orderkey) AS k FROM orders) SELECT o_orderpriority AS stratum, count(*) AS n, round(avg(CASE WHEN o_orderkey % 10 < 6 THEN 1.0 ELSE 0.0 END), 6) AS right_share FROM r WHERE k <= 30 GROUP BY 1")
def en13(spark, d):
    """Thirty facts of each stratum by hash, and the share of them that verdicts call right."""
    w = Window.partitionBy("o_orderpriority").orderBy(F.md5(F.concat_ws("-", F.col("o_orderkey").cast("string"), F.lit(1)).cast("binary")), "o_orderkey")
    r = read(spark, d, "orders").withColumn("k", F.row_number().over(w)).filter("k <= 30")
    return r.groupBy(F.col("o_orderpriority").alias("stratum")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("o_orderkey") % 10 < 6, 1.0).otherwise(0.0)), 6).alias("right_share"))


@query("en15_topic_segments", "WITH v AS (SELECT o_orderkey AS id, o_custkey AS burst, [length(o_orderpriority) - 5.0, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE -1.0 END] AS v FROM orders), f AS (SELECT *, CASE WHEN lag(v) OVER w IS NULL OR list_cosine_similarity(v, lag(v) OVER w) < 0.6 THEN 1 ELSE 0 END AS new FROM v WINDOW w AS (PARTITION BY burst ORDER BY id)) SELECT id, CAST(sum(new) OVER (PARTITION BY burst ORDER BY id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM f")
def en15(spark, d):
    """Turns of a burst embedded by the encoder given, and cut where the subject turns."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("burst"), F.concat_ws("|", "o_orderpriority", "o_orderstatus").alias("text"))
    encode = lambda ts: [[len(t.split("|")[0]) - 5.0, 1.0 if t.endswith("F") else -1.0] for t in ts]
    v = enrich.embedded(o.select("id", "text"), None, "id", "text", encode, unit_length=False)
    return cv.segments_by_similarity(o.join(v, "id"), "burst", "id", "vec", 0.6).select("id", "segment")


@query("en18_handle_history", "WITH m AS (SELECT o_custkey AS id, 'h' || o_custkey || '_' || (o_orderkey % 3) AS handle, o_orderdate AS seen, o_orderkey FROM orders), x AS (SELECT id, handle, min(seen) AS first_seen, count(*) AS n FROM m GROUP BY 1, 2) SELECT id, handle, CAST(first_seen AS TIMESTAMP) AS first_seen, n, handle = CASE WHEN id % 4 = 0 THEN 'h' || id || '_0' ELSE (SELECT arg_max(m.handle, (m.seen, m.o_orderkey)) FROM m WHERE m.id = x.id) END AS current FROM x")
def en18(spark, d):
    """Handles found in mentions; the current one is the profile's where there is one, else the last mentioned."""
    o = read(spark, d, "orders")
    handle = F.concat(F.lit("h"), F.col("o_custkey").cast("string"), F.lit("_"), (F.col("o_orderkey") % 3).cast("string"))
    texts = o.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("msg_id"), F.col("o_orderdate").alias("seen"), F.concat(F.lit("cc @"), handle, F.lit(", mail x@y.z")).alias("text"))
    profiles = o.filter("o_custkey % 4 = 0").select(F.col("o_custkey").alias("id"), F.concat(F.lit("h"), F.col("o_custkey").cast("string"), F.lit("_0")).alias("handle")).distinct()
    return identity.handles(texts, profiles)


@query("en19_made_archive", "SELECT c_name AS thread, 20 + (c_custkey * 37) % 23 AS messages, 1 + (19 + (c_custkey * 37) % 23) % 3 AS authors FROM customer")
def en19(spark, d):
    """A made-up chat for every account, every fourth a storyline, the same each time."""
    from ..sources import archive

    threads = read(spark, d, "customer").select(F.col("c_name").alias("thread"), F.col("c_custkey").alias("k"), (F.col("c_custkey") % 4 == 0).alias("story"))
    return archive.generated(threads).groupBy("thread").agg(F.count("*").alias("messages"), F.count_distinct("author").alias("authors"))


# --- endpoints and tools


@query("qp01_search", f"WITH {bm25_sql(chr(108) + 'ang = ' + chr(39) + 'fr' + chr(39))} SELECT rank, doc_id AS chunk, score, source, left(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), 80) AS excerpt FROM kr JOIN documents USING (doc_id) WHERE rank <= 10")
def qp01(spark, d):
    hits = keyword_leg(spark, d, F.col("lang") == "fr", 10)
    doc = read(spark, d, "documents").select(F.col("doc_id").alias("doc"), "source", F.substring(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "), 1, 80).alias("excerpt"))
    return F.broadcast(hits).join(doc, "doc").select("rank", F.col("doc").alias("chunk"), "score", "source", "excerpt")  # ten rows


@query("qp02_chunk", f"WITH {CHATS_SQL}, c AS (SELECT *, turn // 3 AS chunk FROM chats) SELECT thread_id, chunk, list(msg_id ORDER BY ts, msg_id) AS messages, list_sort(list(DISTINCT author)) AS people, min(ts) AS start_ts FROM c GROUP BY 1, 2")
def qp02(spark, d):
    m = chat_messages(spark, d).withColumn("chunk", F.floor(F.col("turn") / 3))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ts", "msg_id"))), lambda s: s["msg_id"])
    return m.groupBy("thread_id", "chunk").agg(ids.alias("messages"), F.array_sort(F.collect_set("author")).alias("people"), F.min("ts").alias("start_ts"))


@query("qp03_session", f"WITH {SESSIONS_SQL} SELECT session, md5(body) AS h, lag(session) OVER w AS before, lead(session) OVER w AS after FROM s WINDOW w AS (PARTITION BY session % 5 ORDER BY start_ts, session)")
def qp03(spark, d):
    w = Window.partitionBy(F.col("session") % 5).orderBy("start_ts", "session")
    return sessions(spark, d).select("session", MD5("body").alias("h"), F.lag("session").over(w).alias("before"), F.lead("session").over(w).alias("after"))


PERSON_NODES = "n AS (SELECT 'P_' || n_nationkey AS node, 'person' AS kind, n_name AS name, n_nationkey AS messages FROM nation UNION ALL SELECT 'A_' || s_suppkey, 'account', CASE WHEN s_suppkey % 9 = 0 THEN 'nation_1' ELSE 'x nation_1' || s_suppkey % 4 END, s_suppkey FROM supplier)"


def person_nodes(spark, d):
    n = read(spark, d, "nation").select(F.concat(F.lit("P_"), F.col("n_nationkey").cast("string")).alias("node"), F.lit("person").alias("kind"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("messages"))
    name = F.when(F.col("s_suppkey") % 9 == 0, "nation_1").otherwise(F.concat(F.lit("x nation_1"), (F.col("s_suppkey") % 4).cast("string")))
    return n.unionByName(read(spark, d, "supplier").select(F.concat(F.lit("A_"), F.col("s_suppkey").cast("string")).alias("node"), F.lit("account").alias("kind"), name.alias("name"), F.col("s_suppkey").alias("messages")))


def person_sql(k: int) -> str:
    return f"WITH {PERSON_NODES} SELECT node, row_number() OVER (ORDER BY (lower(name) = 'nation_1') DESC, (kind = 'person') DESC, messages DESC, node) AS rank FROM n WHERE contains(lower(name), 'nation_1') ORDER BY rank LIMIT {k}"


@query("qp04_person", person_sql(10))
def qp04(spark, d):
    return identity.candidates(person_nodes(spark, d), " Nation_1 ", 10).select("node", "rank")


@query("qt07_find_person", person_sql(8))
def qt07(spark, d):
    return identity.candidates(person_nodes(spark, d), "NATION_1", 8).select("node", "rank")


@query("qp05_accounts", "SELECT c_custkey AS account_id, c_name AS name, coalesce(n, 0) AS messages FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ON user_id = c_custkey WHERE c_mktsegment = 'BUILDING' AND c_custkey NOT IN (SELECT s_suppkey * 3 FROM supplier)")
def qp05(spark, d):
    """Accounts of a platform that no person has."""
    c = read(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("account_id"), F.col("c_name").alias("name"))
    linked = read(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("account_id"))
    n = read(spark, d, "events").groupBy(F.col("user_id").alias("account_id")).agg(F.count("*").alias("messages"))
    return c.join(linked, "account_id", "left_anti").join(n, "account_id", "left").select("account_id", "name", F.coalesce("messages", F.lit(0)).alias("messages"))


@query("qp06_people", "WITH e AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT c_nationkey AS person_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS messages, list_sort(list(DISTINCT c_mktsegment)) AS platforms, list(c_custkey ORDER BY coalesce(n, 0) DESC, c_custkey) AS accounts FROM customer LEFT JOIN e ON user_id = c_custkey GROUP BY 1")
def qp06(spark, d):
    n = read(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("n"))
    c = read(spark, d, "customer").join(n, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ids = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "c_custkey"))), lambda s: s["c_custkey"])
    return c.groupBy(F.col("c_nationkey").alias("person_id")).agg(F.sum("n").alias("messages"), F.array_sort(F.collect_set("c_mktsegment")).alias("platforms"), ids.alias("accounts"))


@query("qp07_dossiers", f"WITH {EVENTS_SQL}, t AS (SELECT author, thread_id, count(*) AS n, row_number() OVER (PARTITION BY author ORDER BY count(*) DESC, thread_id) AS k FROM msgs GROUP BY 1, 2) SELECT author AS account, (SELECT count(*) FROM msgs m WHERE m.author = t.author) AS messages, list(thread_id ORDER BY k) AS top_chats FROM t WHERE k <= 5 GROUP BY 1")
def qp07(spark, d):
    m = event_messages(spark, d)
    by = m.groupBy("author", "thread_id").agg(F.count("*").alias("n"))
    top = by.withColumn("k", F.row_number().over(Window.partitionBy("author").orderBy(F.desc("n"), "thread_id"))).filter("k <= 5")
    chats = top.groupBy("author").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "thread_id"))), lambda s: s["thread_id"]).alias("top_chats"))
    total = by.groupBy("author").agg(F.sum("n").alias("messages"))
    return total.join(chats, "author").withColumnRenamed("author", "account")


@query("qt04_person_overview", f"WITH {EVENTS_SQL} SELECT author AS account, count(*) AS messages, count(*) FILTER (is_me) AS by_you, count(DISTINCT thread_id) AS chats, min(strftime(make_timestamp(ts * 1000000) + INTERVAL 330 MINUTE, '%Y-%m-%d')) AS first_day, max(strftime(make_timestamp(ts * 1000000) + INTERVAL 330 MINUTE, '%Y-%m-%d')) AS last_day FROM msgs GROUP BY 1")
def qt04(spark, d):
    m = event_messages(spark, d).select(F.col("author").alias("account"), "thread_id", "is_me", times.local_day(F.col("ts")).alias("day"))
    return memory.dossier(m, "account").select("account", "messages", "by_you", "chats", "first_day", "last_day")


@query("qp08_suggestions", "WITH k AS (SELECT c_custkey AS id, 'dup' || (c_custkey // 3) AS k FROM customer) SELECT x.id AS a, y.id AS b FROM k x JOIN k y ON x.k = y.k AND x.id < y.id WHERE NOT (x.id % 3 = 0 AND y.id = x.id + 1)")
def qp08(spark, d):
    """Suggested merges, without a pair that the user has just refused."""
    c = read(spark, d, "customer")
    a = c.select(F.col("c_custkey").alias("account_id"), F.concat(F.lit("u/Dup "), F.floor(F.col("c_custkey") / 3).cast("string")).alias("name"), F.lit(1).alias("messages"))
    refused = c.filter("c_custkey % 3 = 0").select((F.col("c_custkey") + 1).alias("a"), F.col("c_custkey").alias("b"))
    return identity.without_rejected(identity.merge_suggestions(a).select("a", "b"), refused)


@query("qp10_fact_feedback", "SELECT o_orderkey AS fact, CASE WHEN o_orderkey % 4 = 0 THEN 'wrong' ELSE 'ok' END AS verdict FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 6 <> 0")
def qp10(spark, d):
    """Verdicts set anew, and those cleared."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("fact"))
    held = o.filter("fact % 2 = 0").select("fact", F.lit("ok").alias("verdict"))
    new = o.filter("fact % 4 = 0 or fact % 6 = 0").select("fact", F.when(F.col("fact") % 6 != 0, "wrong").alias("verdict"))
    return tb.upserted(held, new, ["fact"]).filter("verdict is not null")


@query("qp11_commitments", "WITH i AS (SELECT o_orderkey AS cid, CASE WHEN o_orderkey % 2 = 0 THEN 'me' ELSE 'them' END AS owner, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END AS due, CAST(o_orderdate AS DATE) - 3 AS said, o_orderpriority AS text FROM orders) SELECT cid, row_number() OVER (ORDER BY coalesce(due, said) DESC, cid) AS k FROM i WHERE owner = 'me' AND contains(lower(text), 'urgent') ORDER BY k LIMIT 60")
def qp11(spark, d):
    due = F.when(F.col("o_orderkey") % 3 == 0, F.to_date("o_orderdate"))
    i = read(spark, d, "orders").select(F.col("o_orderkey").alias("cid"), F.when(F.col("o_orderkey") % 2 == 0, "me").otherwise("them").alias("owner"), F.lit("now").alias("status"), F.col("o_orderpriority").alias("text"), F.lit("").alias("area"), due.alias("due"), F.date_sub(F.to_date("o_orderdate"), 3).alias("said"))
    shown = memory.facets(i, owner="me", status="now", q="URGENT")["items"]
    order = [F.coalesce("due", "said").desc(), F.col("cid")]
    page = shown.orderBy(*order).limit(60)
    return page.select("cid", F.row_number().over(Window.orderBy(*order)).alias("k"))  # a page


@query("qp12_commitment_status", "SELECT o_orderkey AS cid, CASE WHEN o_orderkey % 5 = 0 THEN 'done' ELSE 'now' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS changed FROM orders")
def qp12(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("cid"), F.lit("now").alias("status"))
    after = tb.upserted(o, o.filter("cid % 5 = 0").select("cid", F.lit("done").alias("status")), ["cid"])
    was = tb.changed(o, after, "cid", "status").select("cid", F.lit(1).alias("changed"))
    return after.join(was, "cid", "left").select("cid", "status", F.coalesce("changed", F.lit(0)).alias("changed"))


@query("qp14_day", f"WITH {EVENTS_SQL}, s AS (SELECT thread_id, strftime(make_timestamp(ts * 1000000) + INTERVAL 330 MINUTE, '%Y-%m-%d') AS day, count(*) AS n FROM msgs GROUP BY 1, 2) SELECT thread_id, n FROM s WHERE day = '2024-01-10' ORDER BY n DESC, thread_id LIMIT 25")
def qp14(spark, d):
    """The sessions of a local day, the largest 25."""
    m = event_messages(spark, d).filter(F.col("ts").between(times.day_start(F.lit("2024-01-10")), times.day_start(F.lit("2024-01-10"), end=True) - 1))
    return m.groupBy("thread_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "thread_id").limit(25)


@query("qt02_search_memory", f"WITH {bm25_sql()} SELECT '[' || rank || '] ' || source || ': ' || left(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), 200) AS line FROM kr JOIN documents USING (doc_id) WHERE rank <= 8")
def qt02(spark, d):
    hits = keyword_leg(spark, d, None, 8)
    doc = read(spark, d, "documents").select(F.col("doc_id").alias("doc"), "source", F.substring(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "), 1, 200).alias("t"))
    return F.broadcast(hits).join(doc, "doc").select(F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "source", F.lit(": "), "t").alias("line"))  # eight rows


@query("qt03_read_conversation", f"WITH {SESSIONS_SQL} SELECT session, md5(left(body, 600)) AS h, length(body) > 600 AS cut FROM s")
def qt03(spark, d):
    """A conversation up to a number of characters, and whether that is all."""
    return sessions(spark, d).select("session", MD5(F.substring("body", 1, 600)).alias("h"), (F.length("body") > 600).alias("cut"))


@query("qt05_topic_timeline", f"WITH {bm25_sql()}, h AS (SELECT doc_id, rank, lpad(CAST(1 + doc_id % 12 AS VARCHAR), 2, '0') AS month FROM kr WHERE rank <= 120) SELECT month, count(*) AS n, arg_min(doc_id, rank) AS best FROM h GROUP BY 1 ORDER BY n DESC, month LIMIT 4")
def qt05(spark, d):
    hits = keyword_leg(spark, d, None, 120)
    when = read(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.lpad((1 + F.col("doc_id") % 12).cast("string"), 2, "0").alias("month"))
    return retrieval.timeline(hits, when)


@query("qt06_notes", "SELECT c_custkey AS note, 'v2 ' || c_name AS text FROM customer WHERE c_custkey % 4 = 1 UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey % 4 > 1 AND c_custkey % 4 <> 3")
def qt06(spark, d):
    """Notes kept, kept anew and forgotten; what is forgotten stays in the table, out of sight."""
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("note"), F.col("c_name").alias("text"))
    notes = memory.remembered(memory.remembered(None, c.filter("note % 4 > 0")), c.filter("note % 4 = 1").select("note", F.concat(F.lit("v2 "), "text").alias("text")))
    return memory.listed_notes(memory.forgotten(notes, c.filter("note % 4 = 3").select("note")))


@query("qt10_citations", "SELECT o_orderkey AS answer, list_sort(list_filter(list_distinct([o_orderkey % 9, o_orderkey % 4, 7]), lambda n: n BETWEEN 1 AND 5)) AS cited, list_sort(list_filter(list_distinct([o_orderkey % 9, o_orderkey % 4, 7]), lambda n: n > 5 OR n = 0)) AS invalid FROM orders")
def qt10(spark, d):
    """Numbers that an answer cites and that its sources have, and those that they lack."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("so ["), (k % 9).cast("string"), F.lit("], ["), (k % 4).cast("string"), F.lit(", 7] and [1200]"))
    a = read(spark, d, "orders").select(k.alias("answer"), text.alias("text"))
    known = spark.range(1, 6).select(F.col("id").cast("int").alias("n"))
    return retrieval.resolved_citations(a, known, most=1000)


@query("qt11_attached_notes", "SELECT o_orderkey AS result, list_sort(list('note ' || c_custkey)) AS notes FROM orders JOIN customer ON c_custkey IN (o_custkey, o_custkey + 1) AND c_custkey % 3 = 0 GROUP BY 1")
def qt11(spark, d):
    """Notes about the accounts that a result names."""
    results = read(spark, d, "orders").select(F.col("o_orderkey").alias("result"), F.array(F.col("o_custkey"), F.col("o_custkey") + 1).alias("account_ids"))
    notes = read(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("account_id"), F.concat(F.lit("note "), F.col("c_custkey").cast("string")).alias("note"))
    return memory.with_notes(results, notes)
