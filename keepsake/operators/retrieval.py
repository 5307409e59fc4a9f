"""Keyword, vector and fused search over chunk tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import dot, literal
from .automaton import occurring

K1, B, RRF_K, LEG = 1.2, 0.75, 60, 50
#: Weights of the fields of a chunk in keyword search.
FIELD_WEIGHTS = {"header": 2.0, "text": 1.0, "context": 1.0, "keywords": 0.5}


def filters(platform: str | None = None, accounts: Sequence[int] | None = None, since: int | None = None, until: int | None = None, me_only: bool = False) -> Column | None:
    """The conjunction of the filters that are set. An empty account list lets nothing through; `until` is exclusive."""
    parts = []
    if platform is not None:
        parts.append(F.col("platform") == platform)
    if accounts is not None:
        parts.append(F.arrays_overlap("account_ids", F.array(*map(F.lit, accounts))) if accounts else F.lit(False))
    if since is not None:
        parts.append(F.col("end_ts") >= since)
    if until is not None:
        parts.append(F.col("start_ts") < until)
    if me_only:
        parts.append(F.col("me_involved"))
    return reduce(lambda a, b: a & b, parts) if parts else None


def postings(chunks: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(term, doc, field, tf)"""
    each = [chunks.select(F.col(key).alias("doc"), F.lit(f).alias("field"), F.explode(tx.search_terms(F.coalesce(F.col(f), F.lit("")))).alias("term")) for f in fields]
    return reduce(DataFrame.unionByName, each).groupBy("term", "doc", "field").agg(F.count("*").cast("long").alias("tf"))


def bm25(chunks: DataFrame, query: str, key: str, weights: dict[str, float], k1: float = K1, b: float = B) -> DataFrame:
    """(doc, score) of chunks that have a query term, by a scan of all texts, where there is no index (inverted.py): BM25 with weighted field frequencies, terms of one character left out, no terms no rows. The texts are read once: what is kept of them are lengths and the query's own terms, in a table that counts and scores are made from."""
    from ..sources.shared import kept

    terms = sorted({t for t in query_terms(query) if len(t) > 1})
    spark = chunks.sparkSession
    if not terms:
        return spark.createDataFrame([], f"doc {chunks.schema[key].dataType.simpleString()}, score double")
    wanted = F.array(*map(F.lit, terms))
    cols = [F.col(key).alias("doc")]
    for f in weights:
        words = tx.search_terms(F.coalesce(F.col(f), F.lit("")))
        cols += [F.size(words).alias(f"n_{f}"), F.filter(words, lambda w: F.array_contains(wanted, w)).alias(f"w_{f}")]
    rows = chunks.select(*cols)
    length = reduce(lambda a, c: a + c, (F.col(f"n_{f}") * F.lit(w) for f, w in weights.items()))
    rows = kept(rows.withColumn("dl", length).select("doc", "dl", *(f"w_{f}" for f in weights)), "terms")
    stats = rows.agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl"))
    hits = reduce(DataFrame.unionByName, [rows.select("doc", "dl", F.lit(w).alias("w"), F.explode(f"w_{f}").alias("term")) for f, w in weights.items()])
    tf = hits.groupBy("doc", "dl", "term").agg(F.sum("w").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    scored = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # as many rows as query terms; one row
    idf = F.log(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return scored.groupBy("doc").agg(F.sum(weight).alias("score"))


def query_terms(query: str) -> list[str]:
    """The words of a question."""
    import re

    return re.findall(r"\w+", query.lower())


def dense(vectors: DataFrame, query: Sequence[float], key: str, vector: str, embeddable: Column | None = None, include_short: bool = False) -> DataFrame:
    """(doc, score) by inner product with the query's vector, short chunks left out unless asked for."""
    rows = vectors.filter(F.col(vector).isNotNull())
    if embeddable is not None and not include_short:
        rows = rows.filter(embeddable)
    return rows.select(F.col(key).alias("doc"), dot(F.col(vector), literal(query)).alias("score"))


def top(scored: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """The k best, ties to the smaller doc, with rank from 1."""
    s = F.round("score", digits) if digits is not None else F.col("score")
    best = scored.select("doc", s.alias("score")).orderBy(F.desc("score"), "doc").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc")).cast("long"))  # k rows


def fused(legs: Sequence[DataFrame], k: int = RRF_K, offset: int = 0) -> DataFrame:
    """(doc, score): sums of 1 / (k + rank + offset) over ranked lists, rank from 1. offset -1 gives 1 / (k + rank0)."""
    parts = [leg.select("doc", (1.0 / (F.lit(float(k + offset)) + F.col("rank"))).alias("s")) for leg in legs]
    return reduce(DataFrame.unionByName, parts).groupBy("doc").agg(F.sum("s").alias("score"))


def boosted(scored: DataFrame, mine: DataFrame, boost: float) -> DataFrame:
    """Scores times 1 + boost * share written by the owner; mine: (doc, share)."""
    return scored.join(mine, "doc", "left").select("doc", (F.col("score") * (1 + boost * F.coalesce("share", F.lit(0.0)))).alias("score"))


def reranked(pool: DataFrame, texts: DataFrame, score: Callable[[list[str]], list[float]], k: int) -> DataFrame:
    """The pool (at most some tens of documents) ordered by a model's score alone. score is a callable from texts to numbers and runs in tasks."""
    @F.pandas_udf("double")
    def model(t: pd.Series) -> pd.Series:
        return pd.Series(score(t.tolist()))

    return top(texts.join(F.broadcast(pool.select("doc")), "doc").select("doc", model("text").alias("score")), k)


def timeline(hits: DataFrame, when: DataFrame, months: int = 4) -> DataFrame:
    """(month, n, best): months of ranked hits with counts and best hit, the busiest `months` of them. when: (doc, month)."""
    by = hits.join(when, "doc").groupBy("month").agg(F.count("*").alias("n"), F.min_by("doc", "rank").alias("best"))
    return by.orderBy(F.desc("n"), "month").limit(months)


def retrieval_metrics(ranks: DataFrame, group: str) -> DataFrame:
    """(group, n, r1, r5, r10, mrr) by group and for all; ranks: group and rank from 1, null where not found."""
    hit = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))
    out = ranks.rollup(group).agg(F.count("*").alias("n"), hit(1).alias("r1"), hit(5).alias("r5"), hit(10).alias("r10"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.grouping(group).alias("g"))
    return out.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col(group).cast("string")).alias(group), "n", "r1", "r5", "r10", "mrr")


class QueryVectors:
    """Vectors of queries, encoded once; several may be fetched ahead in one call. A query that can't be encoded has none."""

    def __init__(self, encode: Callable[[list[str]], list[Sequence[float]]]):
        self.encode, self.held = encode, {}

    def prefetch(self, queries: Sequence[str]) -> None:
        new = [q for q in dict.fromkeys(queries) if q not in self.held]
        try:
            self.held.update(zip(new, self.encode(new), strict=True))
        except Exception:  # an encoder elsewhere may fail in any way; the search goes on by keywords
            return

    def get(self, query: str) -> Sequence[float] | None:
        if query not in self.held:
            self.prefetch([query])
        return self.held.get(query)


def legs(vectors: QueryVectors, query: str, dense_leg: Callable, keyword_leg: Callable) -> list[DataFrame]:
    """The ranked lists of a query: by vector and by keyword, or by keyword alone where it has no vector."""
    v = vectors.get(query)
    return [keyword_leg()] if v is None else [dense_leg(v), keyword_leg()]


def first_chunks(members: DataFrame) -> DataFrame:
    """(msg_id, chunk): the first chunk that holds each message."""
    return members.groupBy("msg_id").agg(F.min("chunk").alias("chunk"))


def resolved_citations(answers: DataFrame, known: DataFrame, most: int = 1000) -> DataFrame:
    """(answer, cited, invalid): the numbers that an answer cites and that are known, and the others under `most`. answers: (answer, text), known: (n)."""
    each = answers.select("answer", F.explode_outer(tx.cited_numbers(F.col("text"))).alias("n"))
    both = each.join(F.broadcast(known.select("n", F.lit(True).alias("_k"))) if known.count() <= 100_000 else known.select("n", F.lit(True).alias("_k")), "n", "left")
    sets = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("n"))))
    return both.groupBy("answer").agg(sets(F.col("_k").isNotNull()).alias("cited"), sets(F.col("_k").isNull() & (F.col("n") < most)).alias("invalid"))


def containing(keywords: DataFrame, texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(keyword, doc): the texts that hold a keyword between word edges, whatever their case. Texts stay where they are; an automaton of the keywords goes over them."""
    words = lambda c: F.filter(F.split(tx.name_key(F.col(c)), " "), lambda w: w != "")
    rows = texts.select(F.col(key).alias("id"), words(text).alias("tokens"))
    found = occurring(rows, keywords.select(F.col("keyword").alias("pattern"), words("keyword").alias("tokens")).distinct())
    return found.select(F.col("pattern").alias("keyword"), F.col("id").alias("doc"))
