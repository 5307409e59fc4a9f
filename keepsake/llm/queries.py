"""The registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, fingerprints, hilbert_search, mixing, ngram_join, pii, repair, secret_scan, sentencepiece_codec, sharding, token_counts, toxicity, warc
from .common import removed, scratch, table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), width=4, percent=85)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.with_digests(sentencepiece_codec.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_search.search(table(spark, sf_dir, "embeddings"), k=10, queries="vec_id % 100 = 0")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan(table(spark, sf_dir, "documents"), weights=(1, 2, 3), share=1.0, most=3)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"), "source")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts_by_section(token_counts.section_counts(table(spark, sf_dir, "documents"), fields=("source", "lang", "text"), joint=" ", rule="most"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.scored(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write(warc.records(table(spark, sf_dir, "pages"), least=0), path)
    pages = warc.page_table(warc.read_chunks(spark, path, with_data=False))
    removed(spark, path)  # its page table is stored
    return pages


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.spans(table(spark, sf_dir, "documents")))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.ranked(collocations.phrases(table(spark, sf_dir, "documents"), least=100, longest=5), most=2000)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(table(spark, sf_dir, "conversations"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.report(secret_scan.spans(docs, secret_scan.train(docs)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ngram_join, op2_sentencepiece, op3_nearest_neighbours, op4_source_mix, op5_fingerprints, op6_token_counts, op7_toxicity, op8_shards, op9_warc, op10_pii, op11_collocations, op12_repair, op13_secrets)}

#: Shingles as lists of words, all pairs that share one, and components by the smallest id that links reach.
OP1 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, w[k : k + 3] AS s FROM (SELECT doc_id, w, unnest(range(1, 1 + CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 3, 1) END)) AS k FROM words)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * shared >= 85 * (p.n + q.n - shared)
), reached(doc_id, far) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM reached r JOIN links l ON l.x = r.far
)
SELECT d.doc_id, CAST(coalesce(max(n), 0) AS BIGINT) AS n_shingles, min(r.far) AS component_id, CAST(coalesce(max(c), 0) AS BIGINT) AS n_links
FROM documents d JOIN reached r USING (doc_id) LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT x AS doc_id, count(*) AS c FROM links GROUP BY x) USING (doc_id)
GROUP BY d.doc_id
"""

#: SHA-1 from hex to base32: a digit for each five bits.
OP9 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best FROM pages
), bits AS (
  SELECT page_id, h, best, array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', sha1(h)[i])]), '') AS b FROM p
)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + CAST(list_sum(list_transform(range(1, 6), lambda j: CASE WHEN b[5 * k + j] = '1' THEN 1 << (5 - j) ELSE 0 END)) AS INTEGER)]), '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to
FROM bits
"""

#: All phrases of up to five words by place; a cut's parts are phrases too, so their counts stand in the same table.
OP11 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k AS words, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT lang, w, unnest(range(1, 6)) AS k FROM worded WHERE len(w) > 0)
  )
), counts AS (
  SELECT lang, words, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100
), sizes AS (
  SELECT lang, count(*) AS n FROM grams WHERE words = 1 GROUP BY lang
), candidates AS (
  SELECT c.*, string_split(phrase, ' ') AS w FROM counts c WHERE words >= 2
), held AS (
  SELECT lang, unnest([array_to_string(w[1 : words - 1], ' '), array_to_string(w[2 : words], ' ')]) AS phrase, a FROM candidates WHERE words >= 3
), kept AS (
  SELECT c.* FROM candidates c LEFT JOIN (SELECT lang, phrase, max(a) AS most FROM held GROUP BY ALL) h USING (lang, phrase) WHERE coalesce(most, 0) < a
), cuts AS (
  SELECT k.lang, k.phrase, k.a, k.cut, l.a AS l, r.a AS r, n, (1000 * k.a::HUGEINT * n::HUGEINT) // (l.a::HUGEINT * r.a::HUGEINT) AS score
  FROM (SELECT *, unnest(range(1, words)) AS cut FROM kept) k
  JOIN counts l ON l.lang = k.lang AND l.words = k.cut AND l.phrase = array_to_string(k.w[1 : k.cut], ' ')
  JOIN counts r ON r.lang = k.lang AND r.words = k.words - k.cut AND r.phrase = array_to_string(k.w[k.cut + 1 : k.words], ' ')
  JOIN sizes s ON s.lang = k.lang
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS first FROM cuts
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE first = 1
)
SELECT lang, rank, phrase, CAST(len(string_split(phrase, ' ')) AS BIGINT) AS words, a, l, r, n, CAST(score AS BIGINT) AS score, CAST(cut AS INTEGER) AS cut FROM ranked WHERE rank <= 2000
"""

#: CRC-32 bit by bit; the cheapest repair row by row, costs of nine digits before their audits so that the least string is the cheapest, then the ASCII-least; the audit then read off over the rows.
OP12 = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), coded AS (
  SELECT *, xor(list_reduce([CAST(4294967295 AS BIGINT)] || flatten(list_transform(range(1, len(key) + 1), lambda i: [CAST(ascii(key[i]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, CASE WHEN acc & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295) % 20 AS how FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN how = 3 THEN [0, 1] ELSE [0] END) AS copy FROM coded WHERE how <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS k FROM damaged)
), faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN nth > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault, role[1:1] AS own,
    lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY k) AS prior FROM placed
), ways(conv_id, k, c0, c1, c2, c3) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), '000000000', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM faulty
  UNION ALL
  SELECT conv_id, k,
    printf('%09d', CAST(e0[1:9] AS INTEGER) + 2) || e0[10:] || 'D',
    least(printf('%09d', CAST(e1[1:9] AS INTEGER) + 2) || e1[10:] || 'D', CASE WHEN NOT gone AND own = 's' THEN printf('%09d', CAST(e0[1:9] AS INTEGER) + late) || e0[10:] || 'K' END),
    least(printf('%09d', CAST(e2[1:9] AS INTEGER) + 2) || e2[10:] || 'D', CASE WHEN NOT gone THEN printf('%09d', CAST(u[1:9] AS INTEGER) + late + CASE WHEN own = 'u' THEN 0 ELSE 1 END) || u[10:] || CASE WHEN own = 'u' THEN 'K' ELSE 'R' END END),
    least(printf('%09d', CAST(e3[1:9] AS INTEGER) + 2) || e3[10:] || 'D', CASE WHEN NOT gone THEN printf('%09d', CAST(e2[1:9] AS INTEGER) + late + CASE WHEN own = 'a' THEN 0 ELSE 1 END) || e2[10:] || CASE WHEN own = 'a' THEN 'K' ELSE 'R' END END)
  FROM (SELECT *, least(e0, e1, e3) AS u FROM (
    SELECT f.conv_id, f.k, own, fault IN ('b', 'd') AS gone, CASE WHEN fault = 't' THEN 5 ELSE 0 END AS late, c0 AS e0, c1 AS e1,
      least(c2, printf('%09d', CAST(c0[1:9] AS INTEGER) + 5) || c0[10:] || 'I', printf('%09d', CAST(c1[1:9] AS INTEGER) + 5) || c1[10:] || 'I', printf('%09d', CAST(c3[1:9] AS INTEGER) + 5) || c3[10:] || 'I') AS e2,
      least(c3, printf('%09d', CAST(c0[1:9] AS INTEGER) + 10) || c0[10:] || 'II', printf('%09d', CAST(c1[1:9] AS INTEGER) + 10) || c1[10:] || 'II', printf('%09d', CAST(c2[1:9] AS INTEGER) + 5) || c2[10:] || 'I') AS e3
    FROM ways w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.k = w.k + 1))
), best AS (
  SELECT conv_id, least(c0, c3, printf('%09d', CAST(c0[1:9] AS INTEGER) + 10) || c0[10:] || 'II', printf('%09d', CAST(c1[1:9] AS INTEGER) + 10) || c1[10:] || 'II', printf('%09d', CAST(c2[1:9] AS INTEGER) + 5) || c2[10:] || 'I') AS way
  FROM ways w WHERE k = (SELECT max(k) FROM faulty f WHERE f.conv_id IS NOT DISTINCT FROM w.conv_id)
), walk(conv_id, p, k, state, lines) AS (
  SELECT conv_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0, CAST([] AS VARCHAR[]) FROM best
  UNION ALL
  SELECT b.conv_id, p + 1, CASE WHEN edit = 'I' THEN w.k ELSE w.k + 1 END,
    CASE WHEN edit = 'D' THEN state WHEN edit = 'K' THEN CASE own WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END WHEN state = 2 THEN 3 ELSE 2 END,
    CASE edit WHEN 'D' THEN lines WHEN 'K' THEN lines || [role || ':' || text] WHEN 'R' THEN lines || [CASE WHEN state = 2 THEN 'assistant' ELSE 'user' END || ':' || text] ELSE lines || [CASE WHEN state = 2 THEN 'assistant:' ELSE 'user:' END] END
  FROM (SELECT w.*, way, way[10 + p : 10 + p] AS edit FROM walk w JOIN best b ON b.conv_id IS NOT DISTINCT FROM w.conv_id WHERE p < len(way) - 9) w
  JOIN best b ON b.conv_id IS NOT DISTINCT FROM w.conv_id LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.k = w.k + 1
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (prior IS NOT NULL AND prior || own NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
  CAST(coalesce(CAST(way[1:9] AS BIGINT), 0) AS BIGINT) AS cost, coalesce(way[10:], '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.p = len(way) - 9
"""

#: DuckDB SQL where SQL can express the query; the others are tested against brute force, the library or held-out accuracy in tests/llm.
ORACLES: dict[str, str] = {"op1_ngram_join": OP1, "op9_warc": OP9, "op11_collocations": OP11, "op12_repair": OP12}
