"""Joins of vectors at a cosine threshold and of the k nearest, exact, as products of matrices; and a metric index.

Joins deal both sides of a group into chunks; each pair of chunks is one product (_products). The index:

Angles between vectors are a metric. Pivots are taken from a bounded sample of the vectors, each the one farthest from those
before. A vector of the indexed side lies in the block of its group and nearest pivot; blocks of more than CHUNK rows are
dealt into chunks. A vector of the asking side goes to the blocks that the triangle inequality leaves it: with t the angle of
the threshold, d its angle to a block's pivot and e its angle to its own nearest one, blocks with d - e > 2 t are out (whoever
lies there is nearer to that pivot than to any other), and so are those whose vectors' angles to their pivot all differ from
d by more than t. Inside a block a pair is compared only if its two angles to that pivot, and to WITNESSES more pivots, differ
by no more than t. What is left is decided by the cosine itself.

A group that holds most rows is spread over blocks and chunks, and the rows of a chunk are bounded; what is sent to blocks is
the asking side once for each block left. Vectors that spread evenly in many dimensions under a low threshold leave all
blocks: then the join compares all pairs of a group, in chunks. Vectors without a cosine (null, zero, with nulls) match none;
vectors of another length than the pivots meet by length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, norm
from ..sources.shared import kept

#: Vectors that pivots are chosen from, pivots, and pivots whose angles are compared beside a block's own.
SAMPLE, PIVOTS, WITNESSES = 4000, 128, 6
#: Indexed rows of a block that meet in one task.
CHUNK = 20_000
#: Rows of a side that meet in one product of matrices.
DEALT = 4_000
#: Rows of block counts that are broadcast.
BLOCKS = 200_000
#: Radians by which bounds are kept wide, for rounding.
SLACK = 1e-4


def pivots_of(vectors: DataFrame, vector: str, count: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Unit vectors far from one another, from the first `sample` vectors by hash: each is the one whose nearest pivot so far is farthest."""
    rows = vectors.select(F.col(vector).alias("v")).filter(norm(F.col("v")) > 0).orderBy(F.xxhash64("v")).limit(sample).collect()
    if not rows:
        return np.zeros((0, 0))
    width = len(rows[0].v)
    x = np.array([r.v for r in rows if len(r.v) == width], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near, out = x @ x[0], [0]
    # a pivot for some 16 of the sample at most: more cost more than they part
    while len(out) < min(count, 1 + len(x) // 16) and near.min() < 1 - 1e-9:
        out.append(int(near.argmin()))
        near = np.maximum(near, x @ x[out[-1]])
    return x[out]


def _placed(rows: DataFrame, vector: str, pivots: np.ndarray, angle: str | None) -> DataFrame:
    """rows with `_block`, `_d` (angle to that block's pivot) and `_w` (angles to the witnesses). angle None: the row's own block; else one row for each block that the angle in the column named leaves."""
    schema = rows.select("*", F.lit(0).alias("_block"), F.lit(0.0).alias("_d"), F.array(F.lit(0.0)).alias("_w")).schema
    at = rows.columns.index(vector)
    width = pivots.shape[1] if len(pivots) else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(at)
            sizes = np.diff(column.offsets.to_numpy())
            row, block, d = np.arange(b.num_rows), -1 - sizes, np.zeros(b.num_rows)
            even = np.flatnonzero(sizes == width)
            wit = np.zeros((b.num_rows, min(WITNESSES, len(pivots))))
            if len(even):
                x = column.take(pa.array(even)).flatten().to_numpy(zero_copy_only=False).reshape(len(even), width).astype(np.float64)
                far = np.arccos(np.clip(x @ pivots.T / np.linalg.norm(x, axis=1, keepdims=True), -1, 1))
                own = far.argmin(1)
                wit[even] = far[:, : wit.shape[1]]
                if angle is None:
                    block[even], d[even] = own, far[np.arange(len(even)), own]
                else:
                    most = b.column(b.schema.names.index(angle)).to_numpy()[even, None]
                    keep, to = np.nonzero(far - far.min(1, keepdims=True) <= 2 * most + SLACK)
                    odd = np.flatnonzero(sizes != width)
                    row, block, d = np.concatenate([even[keep], odd]), np.concatenate([to, -1 - sizes[odd]]), np.concatenate([far[keep, to], np.zeros(len(odd))])
            for a in range(0, len(row), 20_000):
                part = row[a : a + 20_000]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * wit.shape[1]), pa.array(wit[part].ravel()))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(part)) for c in b.columns), pa.array(block[a : a + 20_000], pa.int32()), pa.array(d[a : a + 20_000]), lists], names=schema.names)

    return rows.mapInArrow(run, schema)


def _group(rows: DataFrame, by: str | None, vector: str) -> DataFrame:
    """rows that have a cosine, their group in `_g` instead of by."""
    alive = F.coalesce(norm(F.col(vector)) > 0, F.lit(False)) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")))
    rest = [c for c in rows.columns if c != by]
    return (rows.select(F.lit(0).alias("_g"), *rest) if by is None else rows.filter(F.col(by).isNotNull()).select(F.col(by).alias("_g"), *rest)).filter(alive)


class Index:
    """The blocks of one side, written once; any number of joins may ask them. right: rows with a vector; by: column of the group that both sides must share, None for one group of all."""

    def __init__(self, right: DataFrame, by: str | None, vector: str = "vec", pivots: np.ndarray | None = None):
        self.by, self.vector, self.columns = by, vector, [c for c in right.columns if c != by]
        right = _group(right, by, vector)
        self.pivots = pivots_of(right, vector) if pivots is None else pivots
        self.rows = kept(_placed(right, vector, self.pivots, None), "index")
        blocks = self.rows.groupBy("_g", "_block").agg(F.count("*").alias("_n"), F.min("_d").alias("_low"), F.max("_d").alias("_high"))
        blocks = kept(blocks.select("_g", "_block", F.ceil(F.col("_n") / CHUNK).cast("int").alias("_chunks"), "_low", "_high"), "blocks")
        self.blocks = F.broadcast(blocks) if blocks.count() <= BLOCKS else blocks

    def chunked(self) -> DataFrame:
        chunk = F.pmod(F.xxhash64(*self.columns), F.col("_chunks")).cast("int")
        r = self.rows.join(self.blocks.select("_g", "_block", "_chunks"), ["_g", "_block"])
        return r.select("_g", "_block", chunk.alias("_chunk"), F.col("_d").alias("_rd"), F.col("_w").alias("_rw"), *(F.col(c).alias(f"r_{c}") for c in self.columns))

    def asked(self, left: DataFrame, angle: Column) -> DataFrame:
        """Pairs of rows that the index can't tell to be at more than an angle: left's columns with l_ before, the indexed with r_."""
        use = [c for c in left.columns if c != self.by]
        left = _group(left, self.by, self.vector).withColumn("_a", angle.cast("double"))
        a = F.col("_a")
        met = _placed(left, self.vector, self.pivots, "_a").join(self.blocks, ["_g", "_block"]).filter((F.col("_d") >= F.col("_low") - a) & (F.col("_d") <= F.col("_high") + a))
        met = met.select("_g", "_block", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_chunk"), "_a", "_d", "_w", *(F.col(c).alias(f"l_{c}") for c in use))
        pairs = met.join(self.chunked(), ["_g", "_block", "_chunk"]).filter(F.abs(F.col("_d") - F.col("_rd")) <= a)
        for k in range(min(WITNESSES, len(self.pivots))):
            pairs = pairs.filter(F.abs(F.get("_w", F.lit(k)) - F.get("_rw", F.lit(k))) <= a)
        return pairs.select(*((F.col("_g").alias(self.by),) if self.by else ()), *(f"l_{c}" for c in use), *(f"r_{c}" for c in self.columns))

    def bounds(self, left: DataFrame, key: str, k: int) -> DataFrame:
        """(key, _bound): an angle within which each row of left (key unique) has k indexed rows of its group: that to the k-th nearest in the first chunk of its own block, pi where there are fewer."""
        own = _placed(_group(left.select(*({key, self.vector} | ({self.by} if self.by else set()))), self.by, self.vector), self.vector, self.pivots, None)
        met = own.join(self.chunked().filter("_chunk = 0"), ["_g", "_block"])
        angles = met.select(key, F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine(F.col(self.vector), F.col(f"r_{self.vector}"))))).alias("_x"))
        near = angles.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("_x"))).filter(F.col("_k") == k)
        return left.select(key).join(near.select(key, "_x"), key, "left").select(key, (F.coalesce("_x", F.lit(float(np.pi))) + SLACK).alias("_bound"))


def candidates(left: DataFrame, right: DataFrame, least: float, by: str | None, vector: str = "vec", pivots: np.ndarray | None = None) -> DataFrame:
    """Pairs that the index leaves for a cosine of `least` or more."""
    return Index(right, by, vector, pivots).asked(left, F.lit(float(np.arccos(np.clip(least, -1, 1))) + SLACK))


def _products(left: DataFrame, right: DataFrame, by: str | None, vector: str, pick: Callable, scored: bool = False) -> DataFrame:
    """Pairs of rows of a group and length that pick takes: left's columns with l_ before, right's with r_, without the vectors. Both sides of a group are dealt into chunks of at most some DEALT rows; each pair of chunks goes to pick as two matrices, the right one in the order of its rows' columns, and comes back as places in them and scores (kept as `score` if scored)."""
    parts = []
    for side, df in (("l", left), ("r", right)):
        use = [c for c in df.columns if c != by]
        rows = _group(df, by, vector).withColumn("_len", F.size(vector))
        parts.append(rows.select("_g", "_len", *(F.col(c).alias(f"{side}_{c}") for c in use)))
    l, r = parts
    chunks = lambda df, name: df.groupBy("_g", "_len").agg(F.ceil(F.count("*") / DEALT).cast("int").alias(name))
    sizes = kept(chunks(l, "_ln").join(chunks(r, "_rn"), ["_g", "_len"]), "sizes")
    deal = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = l.join(sizes, ["_g", "_len"]).withColumn("_i", deal(l, "_ln")).withColumn("_j", every("_rn")).drop("_ln", "_rn")
    held = r.join(sizes, ["_g", "_len"]).withColumn("_j", deal(r, "_rn")).withColumn("_i", every("_ln")).drop("_ln", "_rn")
    rights = [f for f in r.schema if f.name not in ("_g", "_len", f"r_{vector}")]
    out = l.drop(f"l_{vector}", "_len").select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in rights), *((F.lit(None).cast("double").alias("score"),) if scored else ())).schema
    order = [(f.name, "ascending") for f in rights] if scored else []
    place = ["_g", "_len", "_i", "_j"]

    def matrix(t: pa.Table, name: str) -> np.ndarray:
        column = t.column(name).combine_chunks()
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        i, j, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if a.num_rows and b.num_rows:
            if order:
                b = b.take(pc.sort_indices(b, sort_keys=order, null_placement="at_start"))
            i, j, score = pick(matrix(a, f"l_{vector}"), matrix(b, f"r_{vector}"))
        i, j = pa.array(i), pa.array(j)
        found = [pa.array(score) if n == "score" and scored else (a if n in a.column_names else b).column(n).take(i if n in a.column_names else j) for n in out.names]
        return pa.table(found, names=out.names)

    pairs = asks.groupBy(*place).cogroup(held.groupBy(*place)).applyInArrow(run, out)
    return pairs.withColumnRenamed("_g", by) if by else pairs.drop("_g")


def _lengths(m: np.ndarray) -> np.ndarray:
    return np.sqrt(np.cumsum(m * m, axis=1)[:, -1])


def _matched(left: DataFrame, right: DataFrame, least: float, by: str | None, vector: str, lengths: bool) -> DataFrame:
    """Pairs of a group at a dot product of `least` or more, or with lengths at that cosine. Pairs within rounding of the threshold are summed again in the order of `dot`."""

    def pick(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, cols = [], []
        nx, ny = (_lengths(m) if lengths else np.ones(len(m)) for m in (x, y))
        for k in range(0, len(x), 500):
            s = x[k : k + 500] @ y.T
            scale = np.outer(nx[k : k + 500], ny)
            slack = 1e-9 * (np.abs(x[k : k + 500]).max(initial=0.0) * np.abs(y).sum(1).max(initial=0.0) if not lengths else 1.0)
            s /= scale
            i, j = np.nonzero(s >= least - slack)
            near = np.flatnonzero(s[i, j] <= least + slack)
            exact = np.cumsum(x[k + i[near]] * y[j[near]], axis=1)[:, -1] / (scale[i[near], j[near]]) if len(near) else np.zeros(0)
            keep = np.ones(len(i), bool)
            keep[near] = exact >= least
            rows.append(k + i[keep])
            cols.append(j[keep])
        i = np.concatenate(rows)
        return i, np.concatenate(cols), np.zeros(len(i))

    return _products(left, right, by, vector, pick)


def _nearest(k: int, decimals: int) -> Callable:
    """For _products: the k of y nearest to each of x by their cosine to so many decimals, ties to the earlier; where rounding leaves it open who is among them, some more."""
    unit = 10.0**decimals

    def pick(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, cols, scores = [], [], []
        nx, ny = _lengths(x), _lengths(y)
        for at in range(0, len(x), 500):
            s = (x[at : at + 500] @ y.T) / np.outer(nx[at : at + 500], ny)
            least = np.partition(s, len(y) - k, axis=1)[:, len(y) - k] if len(y) > k else np.full(len(s), -2.0)
            i, j = np.nonzero(s >= least[:, None] - 2 / unit - 1e-12)
            exact = np.concatenate([np.cumsum(x[at + i[a : a + 50_000]] * y[j[a : a + 50_000]], axis=1)[:, -1] for a in range(0, len(i), 50_000)]) / (nx[at + i] * ny[j])
            low, high = (np.floor(exact * unit + 0.5 + e) for e in (-1e-3, 1e-3))
            order = np.lexsort((j, -low, i))
            i, j, exact, low, high = (v[order] for v in (i, j, exact, low, high))
            first = np.searchsorted(i, np.arange(len(s)))
            last = first + np.minimum(np.bincount(i, minlength=len(s)), k) - 1  # the k-th by the lower rounding
            keep = (np.arange(len(i)) <= last[i]) | (high > low[last[i]]) | ((high == low[last[i]]) & (j < j[last[i]]))
            rows.append(at + i[keep])
            cols.append(j[keep])
            scores.append(exact[keep])
        return np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)

    return pick


def cosine_join(left: DataFrame, right: DataFrame, least: float, by: str | None = None, vector: str = "vec", extra: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """Pairs of rows of a group at cosine `least` or more: left's columns with l_ before, right's with r_, without the vectors. extra: a condition on the pair."""
    pairs = _matched(left, right, least, by, vector, True)
    return pairs if extra is None else pairs.filter(extra(pairs))


def dot_join(left: DataFrame, right: DataFrame, least: float, by: str | None = None, vector: str = "vec") -> DataFrame:
    """The same by the dot product, for a positive threshold."""
    if least <= 0:
        raise ValueError("a dot product bounds the angle only where it is positive")
    return _matched(left, right, least, by, vector, False)


def nearest_join(left: DataFrame, right: DataFrame, k: int, key: str, by: str | None = None, vector: str = "vec", decimals: int = 9) -> DataFrame:
    """The k rows of right nearest to each row of left (key unique) in its group: left's columns with l_ before, right's with r_, and `score`, the cosine to so many decimals, and `k` from 1; ties go by right's columns. Chunks of both sides meet as products of matrices, each of which gives its k nearest alone."""
    scored = _products(left, right, by, vector, _nearest(k, decimals), True).withColumn("score", F.round("score", decimals))
    order = Window.partitionBy(f"l_{key}").orderBy(F.desc("score"), *(f"r_{c}" for c in right.columns if c not in (by, vector)))
    return scored.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= k)
