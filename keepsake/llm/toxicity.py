"""Toxicity by non-negative positive-unlabelled learning.

Positives are documents that labels call toxic; all else, labelled or not, is unlabelled. Features are the words of a
document and their beginnings, present or not, so length does not count. Features that positives have far more often than
unlabelled documents are kept. Numpy logistic classifiers are fitted on them, each against its own share of the unlabelled
sample, under the non-negative risk: pi * E_P[loss(+)] + max(0, E_U[loss(-)] - pi * E_P[loss(-)]), with the class prior pi
taken from the training labels. Their logits are averaged.

The fit sees at most `positives` and `unlabelled` documents, chosen by hash, all outside the held-out fold; scoring sees
every document whole. Labels, language, source and id are no inputs of a score.

Results: null and empty texts have no features and get the score of the bias alone. Repeated rows get equal scores. Without
positives every score is the prior (0). Extra columns stay out of the scores. An id with several labels is toxic if one of
them says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, lower_ascii, mix, released, slices, small_batches, span_hashes, stored, text_bytes

#: Bytes of a word that make its beginning.
HEAD = 5
#: Bytes of texts whose words are looked at at once: a worker holds some 130 bytes for each.
AT_ONCE = 1 << 17


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of every word of every text, repeats included. Words are runs of ASCII letters and digits and of bytes over 127."""
    raw, offsets = text_bytes(texts)
    raw = lower_ascii(raw)
    inside = ((raw >= 97) & (raw <= 122)) | ((raw >= 48) & (raw <= 57)) | (raw >= 128)
    before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(raw))]
    before[cuts], after[cuts - 1] = False, False
    begins, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(offsets, begins, side="right") - 1
    words = span_hashes(raw, begins, ends)
    long = ends - begins > HEAD
    heads = mix(span_hashes(raw, begins[long], begins[long] + HEAD) + np.uint64(1))
    return np.concatenate([doc, doc[long]]), np.concatenate([words, heads]).view(np.int64)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc, text) to (key, doc, set)."""
    for whole in batches:
        for b in slices(whole, 2, AT_ONCE):
            doc, f = features(b.column(2))
            order = np.lexsort((f, doc))
            doc, f = doc[order], f[order]
            one = np.ones(len(f), bool)
            one[1:] = (f[1:] != f[:-1]) | (doc[1:] != doc[:-1])
            upto = np.concatenate([[0], np.cumsum(np.bincount(doc[one], minlength=b.num_rows))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(f[one]))], names=["row", "positive", "features"])
    released()


def _feature_table(docs: DataFrame, text: str) -> DataFrame:
    """(key, doc, set) -> with features array<long>, distinct."""
    return docs.select("row", "positive", text).mapInArrow(_feature_rows, "row long, positive boolean, features array<long>")


def fit_risk(rows: np.ndarray, cols: np.ndarray, positive: np.ndarray, width: int, prior: float, steps: int = 400, rate: float = 0.1, penalty: float = 2e-4, sparsity: float = 0.12) -> np.ndarray:
    """Weights and bias (last) of a logistic classifier under the non-negative risk; (rows, cols) are the ones of a sparse 0/1 matrix. Adam on full batches with falling steps; after each, weights shrink by sparsity over the number of positives, so features that others make needless go to zero."""
    n, w = len(positive), np.zeros(width + 1)
    w[-1] = -2.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    p, u = positive / max(positive.sum(), 1), ~positive / max((~positive).sum(), 1)
    sparse = sparsity / max(positive.sum(), 1)
    for k in range(1, steps + 1):
        step = rate * min(1.0, 2 * (1 - k / steps) + 0.02)
        z = np.bincount(rows, w[cols], n) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        negative = (u - prior * p) @ np.logaddexp(0, z)
        if negative >= 0:
            g = -prior * p * (1 - s) + (u - prior * p) * s
        else:  # the negative part has gone below what a risk can be: undo that alone
            g = -(u - prior * p) * s
        grad = np.append(np.bincount(cols, g[rows], width), g.sum()) + penalty * np.append(w[:-1], 0) * prior
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        scale = np.sqrt(v / (1 - 0.999**k)) + 1e-8
        w -= step * (m / (1 - 0.9**k)) / scale
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - step * sparse / scale[:-1], 0)
    return w


class Model:
    """Feature hashes in order, their weights, the bias."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        self.keys, self.weights, self.bias = keys, weights, bias

    def logits(self, texts: pa.Array) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        if not len(self.keys):
            return z
        doc, f = features(texts)
        at = np.minimum(np.searchsorted(self.keys, f), len(self.keys) - 1)
        hit = self.keys[at] == f
        pairs = np.unique(doc[hit] * len(self.keys) + at[hit])
        return z + np.bincount(pairs // len(self.keys), self.weights[pairs % len(self.keys)], len(texts))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", positives: int = 6000, unlabelled: int = 24000, kept: int = 2048, classifiers: int = 3) -> Model:
    toxic = labels.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = toxic.agg(F.count("toxic").alias("n"), F.sum(F.col("toxic").cast("long")).alias("p")).first()
    if not counts["p"]:
        return Model(np.zeros(0, np.int64), np.zeros(0), -30.0)
    prior = min(max(counts["p"] / counts["n"], 1e-3), 0.9)
    ids = docs.select("doc_id").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    total = ids.count()
    unit = lambda seed: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11) / F.lit(float(1 << 53))
    marked = toxic.filter("toxic = 1").filter(unit(1) < min(1.0, positives / counts["p"])).select("doc_id", F.lit(True).alias("positive"))
    free = ids.filter(unit(2) < min(1.0, unlabelled / max(total, 1))).select("doc_id", F.lit(False).alias("positive"))
    chosen = marked.unionByName(free)  # a document may stand on both sides: the unlabelled are a sample of all
    chosen = stored(chosen, "sample")
    sample = docs.select("doc_id", text).join(F.broadcast(chosen), "doc_id")  # at most positives + unlabelled rows, give or take their hashes
    sample = sample.select(F.xxhash64("doc_id", "positive").alias("row"), "positive", F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text)).dropDuplicates(["row"])
    table = stored(_feature_table(sample, text), "features")
    sizes = {r["positive"]: r["count"] for r in table.groupBy("positive").count().collect()}
    p, u = sizes.get(True, 0), sizes.get(False, 0)
    if not p:
        return Model(np.zeros(0, np.int64), np.zeros(0), -30.0)
    by = table.select("positive", F.explode("features").alias("f")).groupBy("f").agg(F.count_if("positive").alias("in_p"), F.count_if(~F.col("positive")).alias("in_u"))
    lift = ((F.col("in_p") + 0.5) / (p + 1)) / ((F.col("in_u") + 0.5) / (u + 1))
    best = by.filter(F.col("in_p") >= max(3, 0.01 * p)).withColumn("lift", lift).filter("lift >= 3").orderBy(F.desc(F.col("in_p") * F.log("lift")), "f").limit(kept).select("f")
    keys = np.sort(np.array([r["f"] for r in best.collect()], np.int64))
    if not len(keys):  # nothing tells the positives apart
        discard(table, chosen)
        return Model(keys, np.zeros(0), float(np.log(prior / (1 - prior))))
    wide = F.broadcast(docs.sparkSession.createDataFrame(pa.table({"f": keys}).to_pandas()))  # at most `kept` rows
    seen = table.select("row", "positive", F.explode("features").alias("f")).join(wide, "f").toPandas()
    every = table.select("row", "positive").toPandas()
    discard(table, chosen)
    index = {r: k for k, r in enumerate(every["row"])}
    rows, cols = seen["row"].map(index).to_numpy(), np.searchsorted(keys, seen["f"].to_numpy())
    positive = every["positive"].to_numpy(bool)
    share = (every["row"].to_numpy().view(np.uint64) >> np.uint64(7)) % np.uint64(classifiers)
    fitted = []
    for k in range(classifiers):
        use = positive | (share == k)
        place = np.cumsum(use) - 1
        on = use[rows]
        fitted.append(fit_risk(place[rows[on]], cols[on], positive[use], len(keys), prior))
    w = np.mean(fitted, 0)
    return Model(keys, w[:-1], float(w[-1]))


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """docs with a score (0 to 1) in the column named, in place of one of that name."""
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != score]
    schema = docs.select(*names).schema.add(score, "double")
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, at, AT_ONCE):
                z = model.logits(b.column(at))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=[*names, score])
        released()

    return docs.select(*names).mapInArrow(run, schema)
