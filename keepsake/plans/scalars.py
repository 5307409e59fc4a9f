"""Text, time, number and array functions, applied to the archive's columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import times
from ..functions.vectors import cosine, dot, norm
from ..sources.archive import CHATS_SQL, EVENTS_SQL, chat_messages, event_messages, read
from .registry import query

WORD = "[\\p{L}\\p{N}_]+"


@query("pf01_cleaned", "SELECT conv_id, turn, CASE WHEN length(trim(t)) = 0 THEN NULL ELSE trim(regexp_replace(regexp_replace(t, 'https?://(?:www\\.)?([^/\\s]+)\\S*', '[link \\1]', 'g'), '\\s+', ' ', 'g')) END AS text FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '  ' WHEN 1 THEN text || ' see https://www.example.com/x?y=1  now' ELSE text END AS t FROM conversations)")
def pf01(spark, d):
    t = F.when(F.col("turn") % 4 == 0, "  ").when(F.col("turn") % 4 == 1, F.concat("text", F.lit(" see https://www.example.com/x?y=1  now"))).otherwise(F.col("text"))
    return read(spark, d, "conversations").select("conv_id", "turn", tx.cleaned(t).alias("text"))


@query("pf02_id_time", "SELECT event_id, CASE WHEN n > 10000000000000 THEN CAST(floor(((n >> 22) + 1288834974657) / 1000) AS BIGINT) END AS ts FROM (SELECT event_id, event_id * 170000000000000 AS n FROM events)")
def pf02(spark, d):
    n = F.col("event_id").cast("decimal(20,0)") * F.lit(170000000000000).cast("decimal(15,0)")  # past 64 bits from event 54,255 on
    return read(spark, d, "events", "event_id").select("event_id", times.wide_id_time(n).alias("ts"))


@query("fs01_mojibake", "SELECT doc_id, md5(text) AS h FROM documents")
def fs01(spark, d):
    """UTF-8 read as Latin-1 comes back whole, and texts that were right stay."""
    x = read(spark, d, "documents", "doc_id", "text")
    broken = F.when(F.col("doc_id") % 2 == 0, F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")).otherwise(F.col("text"))
    return x.select("doc_id", F.md5(tx.repaired(broken).cast("binary")).alias("h"))


@query("fs03_same_text", "SELECT md5(CASE WHEN k <> '' THEN k ELSE trim(lower(text)) END) AS h, count(*) AS n FROM (SELECT text, regexp_replace(replace(replace(lower(text), 'www.', ''), 'group chat', 'group'), '[^\\p{L}\\p{N}]+', '', 'g') AS k FROM documents) GROUP BY 1")
def fs03(spark, d):
    return read(spark, d, "documents").groupBy(F.md5(tx.same_text(F.col("text")).cast("binary")).alias("h")).agg(F.count("*").alias("n"))


@query("fs04_name_key", "SELECT p_partkey, trim(regexp_replace(lower(p_name || '  ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS k FROM part")
def fs04(spark, d):
    return read(spark, d, "part").select("p_partkey", tx.name_key(F.concat_ws("  ", "p_name", "p_brand")).alias("k"))


@query("fs05_merge_key", "SELECT c_custkey, CASE WHEN length(k) >= 4 THEN k END AS k FROM (SELECT c_custkey, regexp_replace(regexp_replace(lower(CASE WHEN c_custkey % 3 = 0 THEN '@' || c_name WHEN c_custkey % 3 = 1 THEN 'u/' || c_name ELSE 'ab' END), '^(@|u/)', ''), '[^\\p{L}\\p{N}]+', '', 'g') AS k FROM customer)")
def fs05(spark, d):
    c = F.col("c_custkey")
    return read(spark, d, "customer").select("c_custkey", tx.merge_key(F.when(c % 3 == 0, F.concat(F.lit("@"), "c_name")).when(c % 3 == 1, F.concat(F.lit("u/"), "c_name")).otherwise("ab")).alias("k"))


@query("fs07_month_span", f"WITH {EVENTS_SQL} SELECT thread_id, CASE WHEN a = b THEN a ELSE a || '/' || b END AS span FROM (SELECT thread_id, strftime(make_timestamp((min(ts) + 19800) * 1000000), '%b %Y') AS a, strftime(make_timestamp((max(ts) + 19800) * 1000000), '%b %Y') AS b FROM msgs GROUP BY 1)")
def fs07(spark, d):
    m = event_messages(spark, d).groupBy("thread_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return m.select("thread_id", times.month_span(F.col("a"), F.col("b")).alias("span"))


@query("fs08_short_name", "SELECT doc_id, CASE WHEN length(text) <= 40 THEN text ELSE regexp_replace(CASE WHEN contains(substr(text, 1, 40), ' ') THEN regexp_extract(substr(text, 1, 40), '(?s)^(.*) ', 1) ELSE substr(text, 1, 40) END, '[\\s,.;:\\-]+$', '') || '…' END AS name FROM documents")
def fs08(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.short_name(F.col("text")).alias("name"))


@query("fs09_token_estimate", "SELECT doc_id, CAST(floor(len(regexp_extract_all(text, '\\S+')) * 1.4::DOUBLE) AS INT) + 1 AS n FROM documents")
def fs09(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("n"))


@query("fs14_search_terms", f"SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM documents) WHERE length(term) > 1 GROUP BY 1")
def fs14(spark, d):
    return read(spark, d, "documents").select(F.explode(tx.search_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query("fs15_unaccented", "SELECT doc_id, md5(strip_accents(text)) AS h FROM documents")
def fs15(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(tx.unaccented(F.col("text")).cast("binary")).alias("h"))


@query("fs16_citations", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '3,7' WHEN 1 THEN '2,3,4' WHEN 2 THEN '' ELSE '5' END AS cited FROM documents")
def fs16(spark, d):
    k = F.col("doc_id") % 4
    t = F.when(k == 0, "as said [3, 7] and [7]").when(k == 1, "see [2–4]").when(k == 2, "far [1-90] no").otherwise("one [5].")
    return read(spark, d, "documents", "doc_id").select("doc_id", F.array_join(tx.cited_numbers(t).cast("array<string>"), ",").alias("cited"))


@query("fs17_redacted", "SELECT count(*) AS docs, CAST(sum(CASE WHEN regexp_matches(text, '[\\p{L}\\p{N}_.+-]+@[\\p{L}\\p{N}_-]+\\.[\\p{L}\\p{N}_.-]+') THEN 1 ELSE 0 END) AS BIGINT) AS with_mail FROM documents")
def fs17(spark, d):
    r = read(spark, d, "documents", "text").select(tx.redacted(F.col("text")).alias("r"))
    return r.agg(F.count("*").alias("docs"), F.count_if(F.col("r").contains("[email hidden]")).alias("with_mail"))


@query("fs18_masked_phone", "SELECT c_custkey, CASE WHEN length(p) < 8 THEN 'WhatsApp user' ELSE replace('+' || left(p, greatest(length(p) - 10, 0)) || ' ' || left(right(p, 10), 2) || '··· ··' || right(p, 3), '+ ', '+') END AS m FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '12345' WHEN c_custkey % 5 = 1 THEN CAST(9000000000 + c_custkey AS VARCHAR) ELSE CAST(919000000000 + c_custkey AS VARCHAR) END AS p FROM customer)")
def fs18(spark, d):
    c = F.col("c_custkey")
    p = F.when(c % 5 == 0, "12345").when(c % 5 == 1, (F.lit(9000000000) + c).cast("string")).otherwise((F.lit(919000000000) + c).cast("string"))
    return read(spark, d, "customer").select("c_custkey", tx.masked_phone(p).alias("m"))


@query("fs19_formatted_phone", "SELECT c_custkey, '+91 ' || substr(p, 3, 5) || ' ' || substr(p, 8, 5) AS f FROM (SELECT c_custkey, CAST(919000000000 + c_custkey AS VARCHAR) AS p FROM customer)")
def fs19(spark, d):
    return read(spark, d, "customer").select("c_custkey", tx.formatted_phone((F.lit(919000000000) + F.col("c_custkey")).cast("string")).alias("f"))


@query("fs20_csv_safe", """SELECT doc_id, CASE WHEN length(s) > 60 THEN substr(s, 1, 60) || '...' ELSE s END AS label FROM (SELECT doc_id, trim(replace(replace(replace(replace(text, ',', ''), chr(13), ''), '"', ''), chr(10), ' ')) AS s FROM documents)""")
def fs20(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.csv_safe(F.col("text"), 60).alias("label"))


@query("fs21_topic_keys", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower(p_type), '\\p{L}{2,}'), lambda w: w NOT IN ('and', 'the', 'of')), lambda w: CASE WHEN length(w) > 4 THEN regexp_replace(w, '(ing|ed|es|s|y)$', '') ELSE w END))), ' ') AS k FROM part")
def fs21(spark, d):
    return read(spark, d, "part").select("p_partkey", F.array_join(tx.topic_key(F.col("p_type")), " ").alias("k"))


@query("fs22_first_sentence", "SELECT doc_id, CASE WHEN length(s) <= 180 THEN s ELSE CASE WHEN contains(substr(s, 1, 179), ' ') THEN regexp_extract(substr(s, 1, 179), '^(.*) ', 1) ELSE substr(s, 1, 179) END || '…' END AS s FROM (SELECT doc_id, CASE WHEN regexp_extract(t, '^(.{20,}?[.!?])(\\s|$)', 1) <> '' THEN regexp_extract(t, '^(.{20,}?[.!?])(\\s|$)', 1) ELSE t END AS s FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents))")
def fs22(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.first_sentence(F.col("text")).alias("s"))


@query("fs24_subreddit", "SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 's' || conv_id END AS s FROM conversations WHERE turn = 0")
def fs24(spark, d):
    title = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("post in r/s"), F.col("conv_id").cast("string"), F.lit(" today"))).otherwise("dm")
    return read(spark, d, "conversations").filter("turn = 0").select("conv_id", tx.subreddit(title).alias("s"))


@query("fs30_stable_ids", f"WITH {CHATS_SQL} SELECT thread_id, 's_' || substr(sha1(string_agg(CAST(msg_id AS VARCHAR), '|' ORDER BY turn)), 1, 16) AS id FROM chats GROUP BY 1")
def fs30(spark, d):
    ids = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("msg_id").cast("string").alias("m")))), lambda s: s["m"])
    return chat_messages(spark, d).groupBy("thread_id").agg(tx.stable_id("s_", ids).alias("id"))


@query("fs32_elided", "SELECT doc_id, md5(CASE WHEN length(text) <= 400 THEN text ELSE substr(text, 1, 200) || chr(10) || '[…]' || chr(10) || right(text, 200) END) AS h FROM documents")
def fs32(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(tx.elided(F.col("text"), 400).cast("binary")).alias("h"))


@query("fs11_split_words", "SELECT doc_id, CAST(ceil(len(string_split(text, ' ')) / 72.0) AS BIGINT) AS pieces FROM documents")
def fs11(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(tx.split_words(F.col("text"), 101)).cast("long").alias("pieces"))


@query("fd01_parsed_times", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS t FROM orders WHERE o_orderkey % 3 <> 2 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 3 = 2")
def fd01(spark, d):
    k = F.col("o_orderkey") % 3
    s = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).when(k == 1, F.date_format("o_orderdate", "MMM dd HH:mm:ss yyyy")).otherwise("never")
    t = F.coalesce(F.try_to_timestamp(F.regexp_replace(s, r"(\.\d+)?Z$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(s, F.lit("MMM dd HH:mm:ss yyyy")))
    return read(spark, d, "orders").select("o_orderkey", F.date_format(t, "yyyy-MM-dd HH:mm:ss").alias("t"))


@query("fd04_local_days", f"WITH {EVENTS_SQL} SELECT msg_id, strftime(make_timestamp((ts + 19800) * 1000000), '%m-%d') AS md, CAST(strftime(make_timestamp((ts + 19800) * 1000000), '%Y') AS BIGINT) AS y FROM msgs")
def fd04(spark, d):
    at = times.local(F.col("ts"))
    return event_messages(spark, d).select("msg_id", F.date_format(at, "MM-dd").alias("md"), F.year(at).cast("long").alias("y"))


@query("fd07_day_bounds", "SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day, (CAST(o_orderdate AS DATE) - DATE '1970-01-01') * 86400 - 19800 AS a, ((CAST(o_orderdate AS DATE) - DATE '1970-01-01') + 1) * 86400 - 19800 AS b FROM orders")
def fd07(spark, d):
    days = read(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).distinct()
    return days.select("day", times.day_start(F.col("day")).alias("a"), times.day_start(F.col("day"), end=True).alias("b"))


@query("fd08_ago", "SELECT DISTINCT CAST(o_orderdate AS DATE) - DATE '1996-01-01' AS n, CASE CAST(o_orderdate AS DATE) - DATE '1996-01-01' WHEN 0 THEN 'today' WHEN 1 THEN 'tomorrow' WHEN -1 THEN 'yesterday' ELSE CASE WHEN CAST(o_orderdate AS DATE) > DATE '1996-01-01' THEN 'in ' || (CAST(o_orderdate AS DATE) - DATE '1996-01-01') || ' days' ELSE (DATE '1996-01-01' - CAST(o_orderdate AS DATE)) || ' days ago' END END AS said FROM orders")
def fd08(spark, d):
    day, today = F.col("o_orderdate").cast("date"), F.lit("1996-01-01").cast("date")
    return read(spark, d, "orders").select(F.datediff(day, today).cast("long").alias("n"), times.ago(day, today).alias("said")).distinct()


@query("fd10_month_spine", "WITH c AS (SELECT o_orderpriority AS p, date_trunc('month', o_orderdate)::DATE AS m, count(*) AS n FROM orders GROUP BY 1, 2), s AS (SELECT p, unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH))::DATE AS m FROM c GROUP BY 1) SELECT s.p, strftime(s.m, '%Y-%m') AS month, coalesce(c.n, 0) AS n FROM s LEFT JOIN c ON c.p = s.p AND c.m = s.m")
def fd10(spark, d):
    from ..operators.memory import month_spine

    c = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return month_spine(c, "p")


@query("fd12_safe_dates", "SELECT doc_id, try_cast(CASE doc_id % 3 WHEN 0 THEN '2024-02-30' WHEN 1 THEN '2024-03-0' || (1 + doc_id % 9) ELSE 'soon' END AS DATE) AS due FROM documents")
def fd12(spark, d):
    k = F.col("doc_id") % 3
    s = F.when(k == 0, "2024-02-30").when(k == 1, F.concat(F.lit("2024-03-0"), (F.col("doc_id") % 9 + 1).cast("string"))).otherwise("soon")
    return read(spark, d, "documents", "doc_id").select("doc_id", F.try_to_date(s, "yyyy-MM-dd").alias("due"))


@query("fd14_freshness", "SELECT o_orderkey, CASE WHEN du = 'transient' AND st = 'current' AND seen < DATE '1997-01-01' - INTERVAL 45 DAY THEN 'past' ELSE st END AS status, coalesce(du = 'state' AND seen < DATE '1997-01-01' - INTERVAL 180 DAY, false) AS stale FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS seen, CASE o_orderkey % 3 WHEN 0 THEN 'transient' WHEN 1 THEN 'state' END AS du, CASE WHEN o_orderstatus = 'F' THEN 'past' ELSE 'current' END AS st FROM orders)")
def fd14(spark, d):
    k = F.col("o_orderkey") % 3
    status, stale = times.fact_freshness(F.when(k == 0, "transient").when(k == 1, "state"), F.when(F.col("o_orderstatus") == "F", "past").otherwise("current"), F.col("o_orderdate").cast("date"), F.lit("1997-01-01"))
    return read(spark, d, "orders").select("o_orderkey", status.alias("status"), stale.alias("stale"))


@query("fm04_vectors", "SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS dot, round(sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])), 5) AS norm, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id // 2")
def fm04(spark, d):
    e = read(spark, d, "embeddings")
    b = e.select(F.col("vec_id").alias("o"), F.col("embedding").alias("w"))
    j = e.join(b, F.floor(F.col("vec_id") / 2) == F.col("o"))
    return j.select("vec_id", *(F.round(x, 5).alias(n) for n, x in (("dot", dot(F.col("embedding"), F.col("w"))), ("norm", norm(F.col("embedding"))), ("cos", cosine(F.col("embedding"), F.col("w"))))))


@query("fa04_arrays", "SELECT l_orderkey, array_to_string(list_transform(list_sort(list(DISTINCT l_suppkey)), lambda x: CAST(x AS VARCHAR)), ',') AS suppliers, array_to_string(list_transform(list_sort(list(DISTINCT l_suppkey))[-2:], lambda x: CAST(x AS VARCHAR)), ',') AS last FROM lineitem GROUP BY 1")
def fa04(spark, d):
    s = F.array_sort(F.collect_set("l_suppkey"))
    txt = lambda a: F.array_join(a.cast("array<string>"), ",")
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(txt(s).alias("suppliers"), txt(F.slice(s, F.greatest(F.size(s) - 1, F.lit(1)), 2)).alias("last"))


@query("fa09_json_checks", "SELECT event_id, json_extract_string(props, '$.k') IS NOT NULL AS ok, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def fa09(spark, d):
    k = F.get_json_object("props", "$.k")
    return read(spark, d, "events").select("event_id", k.isNotNull().alias("ok"), k.cast("long").alias("k"))
