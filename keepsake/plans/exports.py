"""Export readers: each query writes a table in the format of an export and reads it back through the reader."""

from __future__ import annotations

import io
import zipfile
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import tables as tb
from ..operators.inverted import stamp_of
from ..sources import exports as ex
from ..sources.archive import CHATS_SQL, chat_messages, read
from ..sources.shared import fresh, kept
from .registry import query

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def text_files(df: DataFrame, value, *by: str) -> str:
    """Write value, a text a row, as text files, in folders by columns."""
    path = fresh(df.sparkSession, "export")
    w = df.select(*by, value.alias("value")).write
    (w.partitionBy(*by) if by else w).text(path)
    return path


def row_files(df: DataFrame, value, *by: str) -> str:
    """Write value, a text a row, as a text file a row, in folders by columns. A folder holds many files and each task moves its own into place, so the driver doesn't go through them one by one."""
    path = fresh(df.sparkSession, "export")
    w = df.select(*by, value.alias("value")).write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2)
    w.partitionBy(*by).text(path)
    return path


def md5(c) -> F.Column:
    return F.md5(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).cast("binary"))


def broken(c: str) -> F.Column:
    """UTF-8 read as Latin-1, as some exports write it."""
    return F.decode(F.encode(F.col(c), "UTF-8"), "ISO-8859-1")


@query("sc01_zip_members", "SELECT 'a' || conv_id || '.zip' AS archive, 'messages/inbox/c' || conv_id || '/message_' || turn || '.json' AS member, md5(text) AS h FROM conversations WHERE turn % 2 = 0")
def sc01(spark, d):
    c = read(spark, d, "conversations").select(F.col("conv_id"), "turn", "text")

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for k, t, x in zip(part["conv_id"], part["turn"], part["text"], strict=True):
                z.writestr(f"messages/{'inbox' if t % 2 == 0 else 'requests'}/c{k}/message_{t}.json", x)
        return pd.DataFrame({"path": [f"a{part['conv_id'].iloc[0]}.zip"], "content": [out.getvalue()]})

    archives = c.groupBy("conv_id").applyInPandas(pack, "path string, content binary")  # a conversation's turns
    found = ex.zip_members(archives, r"messages/inbox/[^/]+/message_\d+\.json$")
    return found.select("archive", "member", F.md5("content").alias("h"))


@query("sc02_chat_export", f"WITH {CHATS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY ts, turn) AS k FROM chats) SELECT 'inbox/' || thread_id AS thread, 'Té ' || thread_id AS title, author AS sender, ts, md5(content) AS h, k AS place, CASE WHEN k > 1 THEN k - 1 END AS previous FROM o")
def sc02(spark, d):
    m = chat_messages(spark, d).select("*", F.concat(F.lit("Té "), F.col("thread_id").cast("string")).alias("title"))
    each = F.struct(F.col("author").alias("sender_name"), (F.col("ts") * 1000 + F.col("turn") % 7).alias("timestamp_ms"), broken("content").alias("content"))
    one = m.groupBy("thread_id", "title").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", each.alias("m")))), lambda x: x["m"]).alias("messages"))
    path = text_files(one, F.to_json(F.struct(broken("title").alias("title"), F.concat(F.lit("inbox/"), F.col("thread_id").cast("string")).alias("thread_path"), "messages")))
    return ex.chats(spark.read.text(path)).select("thread", "title", "sender", "ts", md5("content").alias("h"), "place", "previous")


@query("sc03_comments", "SELECT doc_id AS ts, lang AS title, md5(text) AS h FROM documents WHERE text IS NOT NULL")
def sc03(spark, d):
    doc = read(spark, d, "documents", "doc_id", "lang", "text")
    new = F.to_json(F.struct(F.col("lang").alias("title"), F.struct(F.struct(F.col("text").alias("value")).alias("Comment"), F.struct(F.col("doc_id").alias("timestamp")).alias("Time")).alias("string_map_data")))
    old = F.to_json(F.struct(F.col("lang").alias("title"), F.col("doc_id").alias("timestamp"), F.array(F.struct(F.struct(F.col("text").alias("comment"), F.lit("me").alias("author")).alias("comment"))).alias("data")))
    path = text_files(doc, F.when(F.col("doc_id") % 2 == 0, new).otherwise(old))
    return ex.comments(spark.read.text(path)).select("ts", "title", md5("content").alias("h"))


def post_files(spark, d) -> DataFrame:
    e = read(spark, d, "events", "event_id", "event_type").select("*", (F.col("event_id") % 4).alias("year"), F.floor(F.col("event_id") / 500).alias("part"))
    e = e.repartition(4 * spark.sparkContext.defaultParallelism, "year", "part")  # by number: making a file takes its time however small it is
    s = lambda c: c.cast("string")
    tweet = F.struct(
        s(F.col("event_id")).alias("id_str"), F.concat_ws(" ", "event_type", s(F.col("event_id") * 7)).alias("full_text"), F.lit("Mon Jan 01 00:00:00 +0000 2024").alias("created_at"),
        F.when(F.col("event_id") % 3 == 1, s(F.floor(F.col("event_id") / 3))).alias("in_reply_to_status_id_str"), F.when(F.col("event_id") % 2 == 1, s(F.floor(F.col("event_id") / 2))).alias("quoted_status_id_str"),
    )
    files = e.groupBy("year", "part").agg(F.to_json(F.collect_list(F.struct(tweet.alias("tweet")))).alias("j"))
    return ex.part_files(spark, row_files(files, F.concat(F.lit("window.YTD.tweets.part0 = "), "j"), "year"), "part-*")


@query("sc04_wrapped_json", "SELECT count(*) AS posts FROM events")
def sc04(spark, d):
    files = post_files(spark, d)
    bare = F.from_json(ex.unwrapped(F.col("value")), "array<string>")
    return files.select(F.explode(bare)).agg(F.count("*").alias("posts"))


@query("sc05_part_files", "SELECT CAST(event_id % 4 AS VARCHAR) AS year, count(DISTINCT event_id // 500) AS files FROM events GROUP BY 1")
def sc05(spark, d):
    return post_files(spark, d).groupBy(F.regexp_extract("path", "year=([0-9]+)", 1).alias("year")).agg(F.count_distinct("path").alias("files"))


@query("sc06_posts", "SELECT CAST(event_id AS VARCHAR) AS id, event_type || ' ' || event_id * 7 AS content, CAST(CASE WHEN event_id % 3 = 1 THEN event_id // 3 WHEN event_id % 2 = 1 THEN event_id // 2 END AS VARCHAR) AS parent FROM events")
def sc06(spark, d):
    return ex.posts(post_files(spark, d)).select("id", "content", "parent")


@query("sc07_direct_messages", f"WITH {CHATS_SQL} SELECT CAST(thread_id AS VARCHAR) AS thread, CAST(msg_id AS VARCHAR) AS id, author AS sender, md5(content) AS h, ts, lag(CAST(msg_id AS VARCHAR)) OVER (PARTITION BY thread_id ORDER BY ts, CAST(msg_id AS VARCHAR)) AS previous FROM chats")
def sc07(spark, d):
    m = chat_messages(spark, d)
    s = lambda c: F.col(c).cast("string")
    at = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    create = F.struct(F.struct(s("msg_id").alias("id"), F.col("author").alias("senderId"), F.col("content").alias("text"), at.alias("createdAt")).alias("messageCreate"))
    one = m.groupBy("thread_id").agg(F.collect_list(create).alias("messages"))
    path = text_files(one, F.concat(F.lit("window.YTD.direct_messages.part0 = ["), F.to_json(F.struct(F.struct(s("thread_id").alias("conversationId"), "messages").alias("dmConversation"))), F.lit("]")))
    return ex.direct_messages(spark.read.text(path)).select("thread", "id", "sender", md5("content").alias("h"), "ts", "previous")


@query("sc08_contexts", "SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 5 = 0 AND p_partkey % 3 <> 2 THEN 'ghost' ELSE 'known' END AS status, CASE WHEN p_partkey % 3 = 2 THEN 'old ' || p_name WHEN p_partkey % 5 <> 0 THEN p_name END AS text FROM part")
def sc08(spark, d):
    p = read(spark, d, "part", "p_partkey", "p_name")
    key, ghost = F.col("p_partkey").cast("string"), F.col("p_partkey") % 5 == 0
    entry = F.struct(F.when(~ghost, F.col("p_name")).alias("text"), F.when(ghost, "gone").alias("error"))
    maps = text_files(p.filter("p_partkey % 3 <> 2").groupBy(F.floor(F.col("p_partkey") / 100)).agg(F.map_from_entries(F.collect_list(F.struct(key.alias("k"), entry.alias("v")))).alias("m")), F.to_json("m"))
    lines = text_files(p.filter("p_partkey % 3 <> 0"), F.to_json(F.struct(key.alias("id"), F.concat(F.lit("old "), "p_name").alias("text"))))
    return ex.contexts(spark.read.text(maps), spark.read.text(lines))


@query("sc09_csv_messages", "SELECT CAST(doc_id AS VARCHAR) AS id, md5(coalesce(text, '')) AS h FROM documents")
def sc09(spark, d):
    path = fresh(spark, "csv")
    read(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), "text").write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return ex.csv_messages(spark, path).select("id", md5("text").alias("h"))


@query("sc10_conversation_threads", "SELECT c_custkey AS id, c_name AS name FROM customer")
def sc10(spark, d):
    c = read(spark, d, "customer", "c_custkey", "c_name")
    items = c.groupBy(F.col("c_custkey") % 5).agg(F.collect_list(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))).alias("conversation_thread"))
    path = text_files(items, F.to_json(F.struct(F.lit("x").alias("other"), "conversation_thread")))
    return ex.conversation_threads(spark, path).select(F.from_json("item", "id long, name string").alias("i")).select("i.*")


@query("sc11_comment_trees", """SELECT o_orderkey AS thread, 'o' || o_orderkey AS id, CAST(NULL AS VARCHAR) AS parent, 0 AS depth FROM orders
 UNION ALL SELECT l_orderkey, 'l' || l_orderkey || '-' || l_linenumber || '-' || l_partkey, 'o' || l_orderkey, 1 FROM lineitem JOIN orders ON o_orderkey = l_orderkey
 UNION ALL SELECT l_orderkey, 's' || l_orderkey || '-' || l_linenumber || '-' || l_partkey, 'l' || l_orderkey || '-' || l_linenumber || '-' || l_partkey, 2 FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")  # fmt: skip
def sc11(spark, d):
    item = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")
    leaf = F.struct(F.concat(F.lit("s"), item).alias("id"), F.lit("deep").alias("body"))
    inner = F.struct(F.concat(F.lit("l"), item).alias("id"), F.lit("reply").alias("body"), F.array(leaf).alias("replies"))
    lines = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").repartition("l_orderkey")  # numbers move, comments are made where they meet
    replies = lines.groupBy("l_orderkey").agg(F.collect_list(inner).alias("replies"))
    o = read(spark, d, "orders").join(replies, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    tree = F.to_json(F.struct(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("body"), "replies"))
    return ex.flattened_comments(o.select(F.col("o_orderkey").alias("thread"), tree.alias("tree"))).select("thread", "id", "parent", "depth")


@query("sc12_ancestor_chain", "SELECT o_orderkey AS thread, k, o_orderkey * 10 + k + 1 AS ancestor, o_orderkey * 10 + k AS parent FROM orders, (SELECT unnest([0, 1, 2]) AS k)")
def sc12(spark, d):
    o = read(spark, d, "orders", "o_orderkey").select(F.col("o_orderkey").alias("thread"), (F.col("o_orderkey") * 10).alias("seed"), F.array(*(F.col("o_orderkey") * 10 + k for k in (3, 2, 1))).alias("chain"))
    return ex.ancestors(o, "thread", "seed", "chain")


@query("sc13_channel_export", f"""WITH {CHATS_SQL} SELECT CAST(thread_id AS VARCHAR) AS channel, CAST(msg_id AS VARCHAR) AS id, author, ts,
 md5(CASE WHEN turn % 4 = 1 THEN 'an embed' WHEN turn % 4 = 2 THEN content || chr(10) || 'an embed' ELSE content END) AS h, CAST(parent_id AS VARCHAR) AS parent FROM chats WHERE turn % 4 <> 3""")  # fmt: skip
def sc13(spark, d):
    m, turn = chat_messages(spark, d), F.col("turn") % 4
    s = lambda c: F.col(c).cast("string")
    embeds = F.when(turn.isin(1, 2), F.array(F.struct(F.lit("an").alias("title"), F.lit("embed").alias("description"))))
    at = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    each = F.struct(s("msg_id").alias("id"), at.alias("timestamp"), F.when(turn.isin(0, 2), F.col("content")).otherwise("  ").alias("content"), F.struct(F.col("author").alias("name")).alias("author"), embeds.alias("embeds"), F.struct(s("parent_id").alias("messageId")).alias("reference"))
    one = m.groupBy("thread_id").agg(F.collect_list(each).alias("messages"))
    path = text_files(one, F.to_json(F.struct(F.struct(s("thread_id").alias("id")).alias("channel"), "messages")))
    return ex.channel(spark.read.text(path)).select("channel", "id", "author", "ts", md5("content").alias("h"), "parent")


STORE = "SELECT event_id AS message_id, user_id AS chat_id, event_id % 9 AS kind, CASE WHEN event_type = 'error' THEN ' ' ELSE event_type END AS text, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events"
KEPT = f"m AS ({STORE}), kept AS (SELECT * FROM m WHERE kind <> 7 AND trim(text) <> '' AND message_id % 11 <> 0)"


def store(spark, d):
    from ..functions import times

    e = read(spark, d, "events")
    text = F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type"))
    m = e.select(F.col("event_id").alias("message_id"), F.col("user_id").alias("chat_id"), (F.col("event_id") % 9).alias("kind"), text.alias("text"), times.epoch(F.col("ts")).alias("ts"))
    chats = read(spark, d, "customer").select(F.col("c_custkey").alias("chat_id"), F.col("c_name").alias("title"))
    return m, chats, m.filter("message_id % 11 = 0")


@query("sc14_messenger_store", f"WITH {KEPT} SELECT message_id, chat_id, c_name AS title, ts, text FROM kept JOIN customer ON c_custkey = chat_id")
def sc14(spark, d):
    return ex.store_messages(*store(spark, d))


@query("pf27_kept_messages", f"WITH {KEPT} SELECT kind, count(*) AS n FROM kept GROUP BY 1")
def pf27(spark, d):
    m, _, revoked = store(spark, d)
    return m.filter(ex.kept_message(F.col("kind"), F.col("text"))).join(revoked.select("message_id"), "message_id", "left_anti").groupBy("kind").agg(F.count("*").alias("n"))


@query("pf26_non_empty_chats", f"WITH {KEPT} SELECT c_custkey AS chat_id, c_name AS title FROM customer WHERE EXISTS (SELECT 1 FROM kept WHERE chat_id = c_custkey)")
def pf26(spark, d):
    m, chats, revoked = store(spark, d)
    return chats.join(ex.store_messages(m, chats, revoked).select("chat_id"), "chat_id", "left_semi")


@query("sc15_contacts", "SELECT lpad(CAST(9000000000 + c_custkey // 2 AS VARCHAR), 10, '0') AS number, min(replace(c_name, '#', ' ,;') || ' x') AS name FROM customer GROUP BY 1")
def sc15(spark, d):
    c = read(spark, d, "customer", "c_custkey", "c_name")
    number = F.concat(F.lit("+91 "), (9000000000 + F.floor(F.col("c_custkey") / 2)).cast("string"))
    card = F.concat(F.lit("BEGIN:VCARD\r\nVERSION:3.0\r\nFN:"), F.replace("c_name", F.lit("#"), F.lit(" \\,\\;")), F.lit("\\nx\r\nTEL;TYPE=CELL:"), number, F.lit("\r\nEND:VCARD\r\n"))
    files = c.groupBy(F.col("c_custkey") % 7).agg(F.array_join(F.collect_list(card), "").alias("v"))
    path = text_files(files, F.col("v"))
    return ex.cards(spark.read.text(path, wholetext=True))


@query("sc16_catalog", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES))
def sc16(spark, d):
    return reduce(DataFrame.unionByName, [read(spark, d, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in TABLES])


@query("sc17_after_mark", "SELECT user_id, count(*) AS n, max(event_id) AS mark FROM events WHERE event_id > 700 GROUP BY 1")
def sc17(spark, d):
    return ex.appended_after(read(spark, d, "events", "event_id", "user_id"), "event_id", 700).groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("mark"))


@query("sc18_vector_version", "SELECT 'held' AS state, count(*) AS n, min(len(embedding)) AS width, true AS fresh FROM embeddings UNION ALL SELECT 'grown', count(*) + count(*) FILTER (vec_id % 2 = 0), min(len(embedding)), false FROM embeddings")
def sc18(spark, d):
    """A version is what the files of a vector table are known by; while it is the same, vectors held need no new scan."""
    path = fresh(spark, "vectors")
    v = read(spark, d, "embeddings", "vec_id", "embedding")
    v.write.parquet(path)
    before = stamp_of(spark, path)
    said = lambda state: spark.read.parquet(path).agg(F.count("*").alias("n"), F.min(F.size("embedding")).cast("long").alias("width")).select(F.lit(state).alias("state"), "n", "width", F.lit(stamp_of(spark, path) == before).alias("fresh"))
    held = kept(said("held"), "version")
    v.filter("vec_id % 2 = 0").write.mode("append").parquet(path)
    return held.unionByName(said("grown"))


@query("sc19_vector_matrix", "SELECT vec_id, len(embedding) AS width, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS squares FROM embeddings")
def sc19(spark, d):
    v = read(spark, d, "embeddings", "vec_id", "embedding")
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return v.select("vec_id", F.size("embedding").cast("long").alias("width"), F.round(squares, 6).alias("squares"))


def quoted(df: DataFrame) -> str:
    path = fresh(df.sparkSession, "graph")
    tb.write_quoted(df, path)
    return path


@query("sc20_graph_csv", "SELECT CAST(page_id AS VARCHAR) AS id, url, md5(html) AS h FROM pages")
def sc20(spark, d):
    p = read(spark, d, "pages").select(F.col("page_id").alias("id"), "url", "html")
    return ex.graph_csv(spark, quoted(p)).select("id", "url", md5("html").alias("h"))


@query("sk12_quoted_csv", "SELECT '\"' || c_custkey || '\",\"' || replace(c_name, '\"', '\"\"') || '\",\"' || c_mktsegment || '\"' AS line FROM customer")
def sk12(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"), F.col("c_mktsegment").alias("kind"))
    return spark.read.text(quoted(c)).filter("value <> '\"id\",\"label\",\"kind\"'").select(F.col("value").alias("line"))


@query("sk13_missing_vectors", "SELECT doc_id AS id, md5(coalesce(text, '')) AS h FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0)")
def sk13(spark, d):
    doc = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    path = fresh(spark, "missing")
    tb.export_missing(doc, read(spark, d, "embeddings").filter("vec_id % 2 = 0").select(F.col("vec_id").alias("id")), "id", path)
    return ex.json_lines(spark, path, "id long, text string").select("id", md5("text").alias("h"))


@query("sc21_gz_json_lines", "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def sc21(spark, d):
    path = fresh(spark, "lines")
    read(spark, d, "documents", "doc_id", "lang", "n_chars").write.option("compression", "gzip").json(path)
    return ex.json_lines(spark, path, "doc_id long, lang string, n_chars long").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("sc22_identity_map", "SELECT r_name AS platform, 'own' || r_regionkey AS alias FROM region")
def sc22(spark, d):
    """The user's own file is missing, so the one that comes along is read."""
    r = read(spark, d, "region").agg(F.map_from_entries(F.collect_list(F.struct("r_name", F.concat(F.lit("own"), F.col("r_regionkey").cast("string"))))).alias("m"))
    found = ex.identity_map(spark, fresh(spark, "none"), text_files(r.coalesce(1), F.to_json("m")))
    return spark.createDataFrame(sorted(found.items()), "platform string, alias string")


KIND_NAMES = ("twitter-2024.zip", "Instagram_me.zip", "my_reddit.zip", "package.zip", "WhatsApp Chat.txt", "people.vcf", "notes.txt")


@query("sc26_export_kinds", "SELECT n_nationkey, CASE n_nationkey % 7 WHEN 0 THEN 'twitter' WHEN 1 THEN 'instagram' WHEN 2 THEN 'reddit' WHEN 3 THEN 'discord' WHEN 4 THEN 'whatsapp' WHEN 5 THEN 'contacts' END AS kind FROM nation")
def sc26(spark, d):
    name = F.element_at(F.array(*map(F.lit, KIND_NAMES)), (F.col("n_nationkey") % 7 + 1).cast("int"))
    return read(spark, d, "nation").select("n_nationkey", ex.kind_of(F.concat(F.lit("/in/"), F.col("n_name"), F.lit("/"), name)).alias("kind"))
