"""A stored inverted index, and BM25 searches that read only the blocks of their terms that can matter.

build() reads the texts once and writes two tables. `docs` has a row for each document: its weighted length, its slot and the
columns that searches may filter by. `blocks` has a row for each term and slot: the documents with the term in order, with
weighted counts and lengths, and as its head the number of them, the largest count and the smallest length. Slots are ranges
of length, dealt further by hash so that they have some BLOCK documents; a term that is in every text is as many blocks as
there are slots. Blocks lie in folders by a hash of their term, sorted by term, so a search opens its terms' folders only.

A slot's heads bound what a document in it can score. A search scores the slots with the highest bounds first, takes the k-th
best score from them, and then reads the other slots only where the bound reaches it. Filters are joined by document; counts
and lengths are then those of the documents that pass, as if no others were there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.shared import fresh, kept
from .retrieval import K1, B, query_terms

#: Documents of a slot, folders of terms, slots whose scores give the first threshold, ranges of length.
BLOCK, FOLDERS, FIRST, RANGES = 4096, 64, 4, 128
#: Words that a task counts at once, some 100 bytes each, and bytes of the batches that they come in.
WORDS, BATCH = 1 << 18, 4 << 20
_OPEN: dict[tuple, InvertedIndex] = {}


def counted(batches: Iterator[pa.RecordBatch], weights: Sequence[float], edges: Sequence[float], deal: int) -> Iterator[pa.RecordBatch]:
    """(doc, lane, words by field) -> (term, slot, doc, tf, dl); documents of some WORDS words are counted at once, where they are."""
    for whole in batches:
        sizes = [np.diff(whole.column(k).offsets.to_numpy()) for k in range(2, whole.num_columns)]
        part = np.cumsum(sum(sizes)) // WORDS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), whole.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            b, size = whole.slice(start, end - start), [s[start:end] for s in sizes]
            words = [b.column(k).flatten() for k in range(2, b.num_columns)]
            dl = sum(s * float(w) for s, w in zip(size, weights, strict=True))
            coded = pa.chunked_array(words).combine_chunks().dictionary_encode()
            if not len(coded):
                continue
            row = np.concatenate([np.repeat(np.arange(b.num_rows), s) for s in size])
            weight = np.concatenate([np.full(len(w), x, np.float64) for w, x in zip(words, weights, strict=True)])
            each, at = np.unique(row * len(coded.dictionary) + coded.indices.to_numpy(), return_inverse=True)
            tf = np.bincount(at, weight)
            doc = each // len(coded.dictionary)
            slot = np.searchsorted(np.asarray(edges, np.float64), dl, side="right") * deal + b.column(1).to_numpy()
            out = [coded.dictionary.take(pa.array(each % len(coded.dictionary))), pa.array(slot[doc], pa.int32()), b.column(0).take(pa.array(doc)), pa.array(tf), pa.array(dl[doc])]
            yield pa.RecordBatch.from_arrays(out, names=["term", "slot", "doc", "tf", "dl"])
    pa.default_memory_pool().release_unused()


def _folder(term: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(folders)).cast("int")


class InvertedIndex:
    """An index in its folder. docs: (doc, dl, slot, ...), blocks: (term, slot, n, most, least, postings, folder)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.docs = spark.read.parquet(f"{path}/docs")
        kind = self.docs.schema["doc"].dataType.simpleString()
        self.blocks = spark.read.schema(f"term string, slot int, n int, total double, most double, least double, postings array<struct<doc:{kind},tf:double,dl:double>>, folder int").parquet(f"{path}/blocks")
        meta = spark.read.parquet(f"{path}/meta").first()
        self.count, self.mean, self.folders = meta["n"], meta["mean"], meta["folders"]

    def of(self, terms: Sequence[str]) -> DataFrame:
        """The blocks of some terms."""
        folders = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(_folder(F.col("t"), self.folders)).distinct().collect()]
        return self.blocks.filter(F.col("folder").isin(*folders) & F.col("term").isin(*terms))

    def terms(self) -> DataFrame:
        """(term, total, docs) of all terms, from the blocks' heads."""
        return self.blocks.groupBy("term").agg(F.sum("total").alias("total"), F.sum("n").cast("long").alias("docs"))

    def search(self, query: str, k: int, where: Column | None = None, digits: int = 6, k1: float = K1, b: float = B) -> DataFrame:
        """(doc, score) of at least the k best documents that have a term of the query and pass where; terms of one character are left out."""
        terms = sorted({t for t in query_terms(query) if len(t) > 1})
        kind = self.docs.schema["doc"].dataType.simpleString()
        if not terms:
            return self.spark.createDataFrame([], f"doc {kind}, score double")
        blocks, count, mean = self.of(terms), self.count, self.mean
        passing = None
        if where is not None:
            passing = self.docs.filter(where).select("doc")
            count, mean = self.docs.filter(where).agg(F.count("*"), F.avg("dl")).first()
            held = self._postings(blocks).join(passing, "doc", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
        else:
            held = blocks.groupBy("term").agg(F.sum("n").alias("n"))
        frequency = {r["term"]: r["n"] for r in held.collect()}  # a row for each term of the query
        if not frequency or not mean:
            return self.spark.createDataFrame([], f"doc {kind}, score double")
        idf = F.element_at(F.create_map(*(x for t, n in frequency.items() for x in (F.lit(t), F.lit(math.log(1 + (count - n + 0.5) / (n + 0.5)))))), F.col("term"))
        weight = lambda tf, dl: idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(mean)))

        def scored(some: DataFrame) -> DataFrame:
            rows = self._postings(some.filter(F.col("term").isin(*frequency)))
            rows = rows if passing is None else rows.join(passing, "doc", "left_semi")
            return rows.groupBy("doc").agg(F.sum(weight(F.col("tf"), F.col("dl"))).alias("score"))

        bounds = self.bounds(blocks, frequency, weight)
        first = [r["slot"] for r in bounds.orderBy(F.desc("bound"), "slot").limit(FIRST + 1).collect()]
        if len(first) <= FIRST:
            return scored(blocks)
        best = scored(blocks.filter(F.col("slot").isin(*first[:FIRST]))).orderBy(F.desc("score")).limit(k).agg(F.count("*").alias("n"), F.min("score").alias("s")).first()
        least = best["s"] - 10.0**-digits if best["n"] == k else 0.0
        return scored(blocks.join(bounds.filter(F.col("bound") >= least).select("slot"), "slot", "left_semi"))

    @staticmethod
    def bounds(blocks: DataFrame, terms: dict, weight) -> DataFrame:
        """(slot, bound): what a document of the slot can score at most."""
        return blocks.filter(F.col("term").isin(*terms)).groupBy("slot").agg(F.sum(weight(F.col("most"), F.col("least"))).alias("bound"))

    @staticmethod
    def _postings(blocks: DataFrame) -> DataFrame:
        return blocks.select("term", F.inline("postings"))


def build(chunks: DataFrame, key: str, weights: dict[str, float], keep: Sequence[str] = (), path: str | None = None, block: int = BLOCK, folders: int = FOLDERS) -> InvertedIndex:
    """Write the index of chunks (key unique) over their text fields with weights. keep: columns to filter by."""
    spark = chunks.sparkSession
    path = path or fresh(spark, "inverted")
    words = {f: tx.search_terms(F.coalesce(F.col(f), F.lit(""))) for f in weights}
    length = reduce(lambda a, c: a + c, (F.size(words[f]) * F.lit(float(w)) for f, w in weights.items()))
    sizes = kept(chunks.select(F.col(key).alias("doc"), length.alias("dl"), *keep), "lengths")
    count = sizes.count()
    ranges = max(1, min(RANGES, -(-count // block)))
    edges = sorted(set(sizes.approxQuantile("dl", [k / ranges for k in range(1, ranges)], 0.5 / ranges))) if count and ranges > 1 else []
    deal = max(1, -(-count // (block * (len(edges) + 1))))
    lane = F.pmod(F.xxhash64("doc"), F.lit(deal))
    place = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: F.col("dl") >= e)) if edges else F.lit(0)
    sizes.withColumn("slot", (place * deal + lane).cast("int")).write.parquet(f"{path}/docs")
    rows = chunks.select(F.col(key).alias("doc"), *(words[f].alias(f"w_{k}") for k, f in enumerate(weights)))
    rows = rows.select("doc", lane.alias("lane"), *(f"w_{k}" for k in range(len(weights))))
    kind, by = rows.schema["doc"].dataType.simpleString(), list(weights.values())
    counts = rows.mapInArrow(lambda batches: counted(batches, by, edges, deal), f"term string, slot int, doc {kind}, tf double, dl double")
    each = counts.groupBy("term", "slot").agg(F.array_sort(F.collect_list(F.struct("doc", "tf", "dl"))).alias("postings"))
    heads = each.select("term", "slot", F.size("postings").alias("n"), F.aggregate("postings", F.lit(0.0), lambda a, p: a + p["tf"]).alias("total"), F.array_max(F.transform("postings", lambda p: p["tf"])).alias("most"), F.array_min(F.transform("postings", lambda p: p["dl"])).alias("least"), "postings", _folder(F.col("term"), folders).alias("folder"))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH))
    try:
        heads.repartition(max(folders, int(spark.conf.get("spark.sql.shuffle.partitions"))), "folder", F.col("slot") % 4).sortWithinPartitions("folder", "term", "slot").write.partitionBy("folder").parquet(f"{path}/blocks")
    finally:
        spark.conf.set(name, before)
    stats = spark.read.parquet(f"{path}/docs").agg(F.count("*").alias("n"), F.avg("dl").alias("mean"), F.lit(folders).alias("folders"))
    stats.coalesce(1).write.parquet(f"{path}/meta")
    return InvertedIndex(spark, path)


def stamp_of(spark: SparkSession, path: str) -> tuple:
    """What the files of a table are known by: their number, bytes and the time of the last change."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    files, at, size, last = fs.listFiles(p, True), 0, 0, 0
    while files.hasNext():
        s = files.next()
        at, size, last = at + 1, size + s.getLen(), max(last, s.getModificationTime())
    return at, size, last


def opened(spark: SparkSession, table: str, key: str, weights: dict[str, float], keep: Sequence[str] = ()) -> InvertedIndex:
    """The index of a Parquet table: built on the first call of the session and when the table's files have changed, kept otherwise."""
    name = (spark.sparkContext.applicationId, table, key, tuple(weights.items()), tuple(keep))
    stamp = stamp_of(spark, table)
    if name not in _OPEN or _OPEN[name].stamp != stamp:
        _OPEN[name] = build(spark.read.parquet(table), key, weights, keep)
        _OPEN[name].stamp = stamp
    return _OPEN[name]
