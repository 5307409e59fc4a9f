"""Keyword, vector and fused search, timelines and retrieval metrics over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import inverted, memory, retrieval, similarity, themes
from ..operators.tables import ordered
from ..sources.archive import CHATS_SQL, chat_messages, read
from .registry import query

#: The words asked for in the registered searches, and the vector: that of one row.
ASKED, ASKED_VECTOR = "The tion une mit und", 7


def vector_of(spark, d, vec_id: int):
    return [float(x) for x in read(spark, d, "embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"]]


def bm25_sql(where: str = "true") -> str:
    return f"""toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS t FROM documents WHERE {where}), w AS (SELECT * FROM toks WHERE length(t) > 1),
 dl AS (SELECT d.doc_id, coalesce(n, 0) AS dl FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM w GROUP BY 1) USING (doc_id) WHERE {where}), st AS (SELECT count(*) AS n, avg(dl) AS a FROM dl),
 tf AS (SELECT doc_id, t, count(*) AS tf FROM w WHERE t IN ('the', 'tion', 'une', 'mit', 'und') GROUP BY 1, 2), df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1),
 kw AS (SELECT doc_id, round(sum(ln(1 + (st.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score FROM tf JOIN df USING (t) JOIN dl USING (doc_id) CROSS JOIN st GROUP BY 1),
 kr AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM kw)"""


DENSE_SQL = "dr AS (SELECT a.vec_id AS doc_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score, row_number() OVER (ORDER BY round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, a.vec_id) AS rank FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 7) b)"


def index(spark, d):
    """The index of the documents' texts, made once for all searches of a session."""
    return inverted.opened(spark, f"{d}/documents.parquet", "doc_id", {"text": 1.0}, ["lang"])


def keyword_leg(spark, d, where=None, k: int = retrieval.LEG):
    return retrieval.top(index(spark, d).search(ASKED, k, where), k, 6)


def dense_leg(spark, d, k: int = retrieval.LEG):
    return retrieval.top(retrieval.dense(read(spark, d, "embeddings"), vector_of(spark, d, ASKED_VECTOR), "vec_id", "embedding"), k, 6)


@query("rt01_dense_search", f"WITH {DENSE_SQL} SELECT doc_id AS doc, score, rank FROM dr WHERE rank <= 50")
def rt01(spark, d):
    return dense_leg(spark, d)


@query("rt02_keyword_search", f"WITH {bm25_sql()} SELECT doc_id AS doc, score, rank FROM kr WHERE rank <= 50")
def rt02(spark, d):
    return keyword_leg(spark, d)


@query("rt10_filtered_search", f"WITH {bm25_sql(chr(108) + 'ang = ' + chr(39) + 'en' + chr(39))} SELECT doc_id AS doc, score, rank FROM kr WHERE rank <= 10")
def rt10(spark, d):
    """Filters come before ranking, so k matches are found where there are k."""
    return keyword_leg(spark, d, F.col("lang") == "en", 10)


@query("rt03_postings", "SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS docs FROM (SELECT t AS term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS t FROM documents) WHERE length(t) > 1 GROUP BY 1, 2) GROUP BY 1")
def rt03(spark, d):
    """From the heads of the blocks that searches read."""
    return index(spark, d).terms().withColumn("total", F.col("total").cast("long"))


FUSED_SQL = f"{bm25_sql()}, {DENSE_SQL}, f AS (SELECT doc_id, round(sum(s), 8) AS score FROM (SELECT doc_id, 1.0::DOUBLE / (60 + rank) AS s FROM kr WHERE rank <= 50 UNION ALL SELECT doc_id, 1.0::DOUBLE / (60 + rank) FROM dr WHERE rank <= 50) GROUP BY 1)"


@query("rt04_hybrid_search", f"WITH {FUSED_SQL} SELECT doc_id AS doc, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM f ORDER BY score DESC, doc_id LIMIT 10")
def rt04(spark, d):
    return retrieval.top(retrieval.fused([dense_leg(spark, d), keyword_leg(spark, d)]), 10, 8)


@query("rt05_multi_query_fusion", f"WITH {bm25_sql()}, {DENSE_SQL}, f AS (SELECT doc_id, round(sum(s), 8) AS score FROM (SELECT doc_id, 1.0::DOUBLE / (59 + rank) AS s FROM kr WHERE rank <= 50 UNION ALL SELECT doc_id, 1.0::DOUBLE / (59 + rank) FROM dr WHERE rank <= 50) GROUP BY 1) SELECT doc_id AS doc, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM f ORDER BY score DESC, doc_id LIMIT 15")
def rt05(spark, d):
    return retrieval.top(retrieval.fused([dense_leg(spark, d), keyword_leg(spark, d)], offset=-1), 15, 8)


@query("rt06_owner_boost", f"WITH {FUSED_SQL}, b AS (SELECT doc_id, round(score * (1 + CASE WHEN doc_id IN (SELECT doc_id FROM documents) THEN 0.3 * (doc_id % 5) / 5.0 ELSE 0 END), 8) AS score FROM f) SELECT doc_id AS doc, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b ORDER BY score DESC, doc_id LIMIT 10")
def rt06(spark, d):
    f = retrieval.fused([dense_leg(spark, d), keyword_leg(spark, d)]).withColumn("score", F.round("score", 8))
    mine = read(spark, d, "documents", "doc_id").select(F.col("doc_id").alias("doc"), (F.col("doc_id") % 5 / 5.0).alias("share"))
    return retrieval.top(retrieval.boosted(f, mine, 0.3), 10, 8)


@query("rt09_topic_timeline", f"WITH {bm25_sql()}, m AS (SELECT '2024-' || lpad(CAST(1 + doc_id % 12 AS VARCHAR), 2, '0') AS month, doc_id, rank FROM kr WHERE rank <= 120) SELECT month, count(*) AS n, arg_min(doc_id, rank) AS best FROM m GROUP BY 1 ORDER BY n DESC, month LIMIT 4")
def rt09(spark, d):
    when = read(spark, d, "documents", "doc_id").select(F.col("doc_id").alias("doc"), F.concat(F.lit("2024-"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0")).alias("month"))
    return retrieval.timeline(keyword_leg(spark, d, k=120), when)


@query("rt12_embedding_text", f"WITH {CHATS_SQL} SELECT msg_id, md5('chat · ' || author || CASE WHEN quality IS NOT NULL THEN chr(10) || 'quality ' || quality ELSE '' END || chr(10) || content) AS h FROM chats LEFT JOIN labels ON doc_id = msg_id")
def rt12(spark, d):
    l = read(spark, d, "labels").select(F.col("doc_id").alias("msg_id"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("context"))
    t = F.concat_ws("\n", F.concat(F.lit("chat · "), "author"), "context", "content")
    return chat_messages(spark, d).join(l, "msg_id", "left").select("msg_id", F.md5(t.cast("binary")).alias("h"))


@query("jn16_vectors_by_label", "SELECT a.vec_id, count(*) AS near FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.2 GROUP BY 1")
def jn16(spark, d):
    e = read(spark, d, "embeddings")
    pairs = similarity.dot_join(e, e, 0.2, "label", "embedding").filter("l_vec_id <> r_vec_id")
    return pairs.groupBy(F.col("l_vec_id").alias("vec_id")).agg(F.count("*").alias("near"))


@query("jn28_vector_alignment", "SELECT d.doc_id, e.vec_id IS NOT NULL AS has_vec FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def jn28(spark, d):
    e = read(spark, d, "embeddings", "vec_id")
    return read(spark, d, "documents", "doc_id").join(e, F.col("vec_id") == F.col("doc_id"), "left").select("doc_id", F.col("vec_id").isNotNull().alias("has_vec"))


KEYWORDS = ("the", "tion", "und", "les", "una", "in the", "de la", "the an", "le le le", "nowhere")


@query("jn24_keyword_containment", f"WITH k AS (SELECT DISTINCT keyword FROM (SELECT ({list(KEYWORDS)})[CAST(p_partkey % 10 AS INT) + 1] AS keyword FROM part)), t AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM documents), n AS (SELECT keyword, count(*) AS n FROM k JOIN t ON contains(t, ' ' || keyword || ' ') GROUP BY 1) SELECT p_partkey AS note, n FROM part JOIN n ON keyword = ({list(KEYWORDS)})[CAST(p_partkey % 10 AS INT) + 1]")
def jn24(spark, d):
    """Each keyword is looked for once, however many notes have it."""
    keyword = F.element_at(F.array(*map(F.lit, KEYWORDS)), (F.col("p_partkey") % 10 + 1).cast("int"))
    notes = read(spark, d, "part").select(F.col("p_partkey").alias("note"), keyword.alias("keyword"))
    found = retrieval.containing(notes.select("keyword").distinct(), read(spark, d, "documents", "doc_id", "text"))
    return notes.join(found.groupBy("keyword").agg(F.count("*").alias("n")), "keyword").select("note", "n")


@query("ag25_retrieval_metrics", "WITH r AS (SELECT lang, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 13 + 1 END AS rank FROM documents) SELECT coalesce(lang, 'ALL') AS lang, count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS r1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS r5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS r10, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM r GROUP BY ROLLUP (lang)")
def ag25(spark, d):
    r = read(spark, d, "documents").select("lang", F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 13 + 1).alias("rank"))
    m = retrieval.retrieval_metrics(r, "lang")
    return m.select("lang", "n", *(F.round(c, 6).alias(c) for c in ("r1", "r5", "r10", "mrr")))


@query("ag28_mean_vectors", "WITH c AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(generate_series(1, len(embedding))) AS k FROM embeddings), m AS (SELECT label, k, avg(x) AS x FROM c GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY 1) SELECT m.label, m.k, round(m.x / n.n, 5) AS x FROM m JOIN n USING (label)")
def ag28(spark, d):
    m = memory.mean_vectors(read(spark, d, "embeddings"), "label", "embedding")
    return m.select("label", F.posexplode("vec").alias("k", "x")).select("label", (F.col("k") + 1).cast("long").alias("k"), F.round("x", 5).alias("x"))


@query("ag29_support", "SELECT f.vec_id AS fact_id, greatest(count(DISTINCT r.vec_id // 10), 1) AS support FROM embeddings f LEFT JOIN embeddings r ON r.label = f.label AND list_cosine_similarity(f.embedding::DOUBLE[], r.embedding::DOUBLE[]) >= 0.2 GROUP BY 1")
def ag29(spark, d):
    e = read(spark, d, "embeddings")
    return memory.support(e.select(F.col("vec_id").alias("fact_id"), F.col("label").alias("entity"), F.col("embedding").alias("vec")), e.select(F.col("label").alias("entity"), F.floor(F.col("vec_id") / 10).alias("session_id"), F.col("embedding").alias("vec")), 0.2)


@query("ag30_distinctive_topics", "WITH t AS (SELECT p_brand AS grp, p_partkey AS item, split_part(p_type, ' ', 1) AS topic FROM part), s AS (SELECT grp, count(DISTINCT item) AS n_in FROM t GROUP BY 1), a AS (SELECT count(DISTINCT item) AS n_all FROM t), i AS (SELECT grp, topic, count(DISTINCT item) AS c_in FROM t GROUP BY 1, 2), o AS (SELECT topic, count(DISTINCT item) AS c_all FROM t GROUP BY 1) SELECT grp, topic, round(c_in / n_in * ln((c_in / n_in + 0.01) / (CASE WHEN n_all > n_in THEN (c_all - c_in) / (n_all - n_in) ELSE 0 END + 0.01)), 6) AS score FROM i JOIN s USING (grp) JOIN o USING (topic), a WHERE c_in >= least(2, n_in)")
def ag30(spark, d):
    t = read(spark, d, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("item"), F.element_at(F.split("p_type", " "), 1).alias("topic"))
    return memory.distinctive(t).withColumn("score", F.round("score", 6))


@query("cl05_similar_components", """WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.35),
 r(id, c) AS (SELECT a, a FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.c) SELECT id, min(c) AS component FROM r GROUP BY 1""")  # fmt: skip
def cl05(spark, d):
    from ..operators.conversations import stitched

    e = read(spark, d, "embeddings").select(F.col("label").alias("entity"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return stitched(memory.similar_pairs(e, 0.35))


@query("cl06_near_duplicates", "SELECT a.vec_id AS id FROM embeddings a WHERE a.vec_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM embeddings b WHERE b.label = a.label AND b.vec_id % 2 = 1 AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3)")
def cl06(spark, d):
    e = read(spark, d, "embeddings").select(F.col("label").alias("entity"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return memory.near_duplicates(e.filter("id % 2 = 0"), e.filter("id % 2 = 1"), 0.3).select("id")


@query("cl01_theme_clusters")
def cl01(spark, d):
    return themes.theme_clusters(read(spark, d, "embeddings"), "label", "vec_id", "embedding")


@query("cl04_dated_clusters", """WITH RECURSIVE u AS (SELECT label AS entity, vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), f AS (SELECT entity, id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v, row_number() OVER (PARTITION BY entity ORDER BY id % 30, id) AS k FROM u),
 w AS (SELECT entity, k, id, 1 AS cluster, [v] AS cents FROM f WHERE k = 1
 UNION ALL SELECT entity, k, id, coalesce(best, len(cents) + 1) AS cluster, CASE WHEN best IS NULL THEN list_append(cents, v) ELSE list_transform(cents, lambda c, i: CASE WHEN i = best THEN list_transform(list_zip(c, v), lambda p: p[1] + p[2]) ELSE c END) END AS cents
  FROM (SELECT *, CASE WHEN list_max(near) >= 0.3 THEN len(near) + 1 - list_position(list_reverse(near), list_max(near)) END AS best FROM (SELECT f.*, w.cents, list_transform(w.cents, lambda c: round(list_cosine_similarity(c, f.v), 12)) AS near FROM w JOIN f ON f.entity = w.entity AND f.k = w.k + 1)))
SELECT entity, id, CAST(cluster - 1 AS BIGINT) AS cluster FROM w""")  # fmt: skip
def cl04(spark, d):
    e = read(spark, d, "embeddings").select(F.col("label").alias("entity"), F.col("vec_id").alias("id"), (F.col("vec_id") % 30).alias("said_on"), F.col("embedding").alias("vec"))
    return themes.dated_clusters(e, 0.3)


@query("qt09_source_numbers", "SELECT doc_id, dense_rank() OVER (ORDER BY first) AS number FROM (SELECT doc_id, min(pos) OVER (PARTITION BY source) AS first FROM (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) AS pos FROM documents))")
def qt09(spark, d):
    """Sources are numbered by the first document that names them; documents take their source's number."""
    doc = read(spark, d, "documents", "doc_id", "source")
    first = doc.groupBy("source").agg(F.min("doc_id").alias("first"))
    number = ordered(first, ["first"], "_k").select(F.col("source").alias("_s"), (F.col("_k") + 1).alias("number"))
    return doc.join(number, F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "number")
