"""Approximate nearest neighbours on several shifted Hilbert curves.

For each curve vectors are projected on a few random directions, shifted at random, and keyed by their place on a Hilbert
curve through those dimensions. The keys of a curve are cut into ranges of equal row counts. A query meets the rows in
the ranges around its own key (a window of `window` of all rows on either side); what the windows of all curves bring is
merged, and the nearest by exact distance on the original vectors stay.

Cut points come from quantiles of a bounded sample of rows; every row is indexed. Rows are range-partitioned once, by the
first curve, and carry their range numbers on the others, so a vector is shuffled once and not once a curve: a piece of at
most about `block` rows (crowded ranges are split further by hash) holds its part of every ordering. Queries, the smaller
side, go to all pieces and pass through a task in batches, so a task holds one piece and one batch. Of equal vectors in a
piece only the k + 1 smallest ids can be among the nearest k, so the others need no comparison.

With vectors spread evenly in all 64 dimensions neighbours are hardly nearer than strangers, so windows must be a share of
the rows: with 8 curves of 4 dimensions and windows of an eighth on either side recall is about 0.97 against brute force
(see tests/llm), and work grows with queries times rows. On clustered vectors far smaller windows do, and then only the
rows inside them are compared: `compared` tells how many.

Results: vectors that are null, zero, of another length than the most common one, or hold null or non-finite components
take no part. Ties go to the smaller vec_id. With fewer candidates all are returned. Rows that repeat a vec_id are
candidates of one another only under different ids; of their distances the smallest counts. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

#: Rows that cut points are taken from, about.
SAMPLE = 20_000
#: A piece has so many rows at least, where there are as many.
LEAST = 1024
#: Pairs that a task compares at once.
PAIRS = 2_000_000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of integer cells (bits a dimension), by undoing the curve's turns from the coarsest bit on and reading the bits across."""
    x = cells.T.astype(np.int64).copy()
    d = len(x)
    for level in range(bits - 1, 0, -1):
        q, below = 1 << level, (1 << level) - 1
        for i in range(d):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(on, below, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[d - 1] >> level) & 1, (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | ((x[i] >> level) & 1)
    return key


class Curves:
    """Directions, shifts and cut points of all curves."""

    def __init__(self, sample: np.ndarray, curves: int, dims: int, ranges: int, seed: int = 7, bits: int = 12):
        rng = np.random.default_rng(seed)
        width = sample.shape[1]
        dims = min(dims, width)
        self.bits, self.mean = bits, sample.mean(0)
        self.directions = [np.linalg.qr(rng.standard_normal((width, dims)))[0] for _ in range(curves)]
        self.shifts = [rng.random(dims) for _ in range(curves)]
        spread = [np.abs((sample - self.mean) @ g).max(0) + 1e-9 for g in self.directions]
        self.scales = [1.05 * s for s in spread]
        # equal cut points are one: a crowded key makes one crowded range, and windows reach past it
        self.cuts = [np.unique(np.quantile(self._keys(sample, c), np.arange(1, ranges) / ranges, method="lower")) for c in range(curves)]

    def _keys(self, x: np.ndarray, c: int) -> np.ndarray:
        place = ((x - self.mean) @ self.directions[c] / self.scales[c] + 1) / 4 + self.shifts[c] / 2
        return hilbert_keys(np.clip(place * (1 << self.bits), 0, (1 << self.bits) - 1).astype(np.int64), self.bits)

    def ranges(self, x: np.ndarray) -> np.ndarray:
        """Range number of each row on each curve."""
        return np.stack([np.searchsorted(cut, self._keys(x, c), side="left") for c, cut in enumerate(self.cuts)], 1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width).astype(np.float64)


class _Piece:
    """The rows of one piece, ready to be met by queries."""

    def __init__(self, batches: list[pa.RecordBatch], width: int, curves: int, k: int):
        ids = np.concatenate([b.column(2).to_numpy() for b in batches])
        raw = np.concatenate([np.asarray(b.column(3).flatten()).reshape(-1, width) for b in batches])
        at = np.concatenate([np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint8).reshape(-1, curves) for b in batches])
        order = np.argsort(ids, kind="stable")
        ids, raw, at = ids[order], raw[order], at[order]
        same = np.unique(np.ascontiguousarray(raw).view(np.dtype((np.void, raw.strides[0]))).ravel(), return_inverse=True)[1].ravel()
        by = np.lexsort((ids, same))
        new = np.ones(len(by), bool)
        new[1:] = (same[by][1:] != same[by][:-1]) | (ids[by][1:] != ids[by][:-1])
        by = by[new]
        first = np.searchsorted(same[by], same[by], side="left")
        keep = np.sort(by[np.arange(len(by)) - first <= k])
        self.ids, self.x, self.at = ids[keep], raw[keep].astype(np.float64), np.ascontiguousarray(at[keep].T)
        self.squares = (self.x**2).sum(1)
        # an id that repeats with other vectors may hold several of the first places
        self.wanted = k * int(np.unique(self.ids, return_counts=True)[1].max())
        self.by = np.argsort(self.at, 1, kind="stable")  # the piece's part of each curve
        self.along = np.take_along_axis(self.at, self.by, 1).astype(np.int64)

    def _windows(self, at: np.ndarray, reach: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(queries, rows) of each window: queries of one range of a curve share it."""
        out = []
        for c in range(len(self.at)):
            for v in np.unique(at[:, c]).astype(int).tolist():
                low, high = np.searchsorted(self.along[c], [v - reach, v + reach + 1])
                if low < high:
                    out.append((np.flatnonzero(at[:, c] == v), self.by[c, low:high]))
        return out

    def nearest(self, asks: np.ndarray, y: np.ndarray, at: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, distance, compared) of the nearest rows inside a window of any curve, by exact distance and id; a query's rows compared here stand at its first row. Windows are met one by one, unless together they are more than the piece."""
        n, own = len(self.ids), (y**2).sum(1)
        windows = self._windows(at, reach)
        if sum(len(q) * len(rows) for q, rows in windows) < n * len(y):
            inside = None
        else:
            inside = np.zeros((len(y), n), bool)
            for q, rows in windows:
                inside[q[:, None], rows] = True
            windows = [(np.arange(len(y)), np.arange(n))]
        seen, pairs = np.zeros(len(y), np.int64), [np.zeros(0, np.int64)]
        for q, rows in windows:
            seen[q] += len(rows)
            good = asks[q][:, None] != self.ids[rows]
            if inside is not None:
                good &= inside
            d = np.where(good, own[q][:, None] + self.squares[rows] - 2 * y[q] @ self.x[rows].T, np.inf)
            m = min(self.wanted, d.shape[1]) - 1
            limit = np.partition(d, m, 1)[:, m] + 1e-9 * (own[q] + self.squares.max())  # rounding in the product
            i, j = np.nonzero((d <= limit[:, None]) & good)
            pairs.append(q[i] * n + rows[j])
        i, j = np.divmod(np.unique(np.concatenate(pairs)), n)
        score = np.sqrt(((y[i] - self.x[j]) ** 2).sum(1))
        order = np.lexsort((self.ids[j], score, i))
        i, j, score = i[order], j[order], score[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i, side="left")
        on = rank < self.wanted
        return asks[i[on]], self.ids[j[on]], score[on], np.where(rank == 0, seen[i], 0)[on]


def search(vectors: DataFrame, k: int = 10, queries: str = "vec_id % 100 = 0", curves: int = 8, dims: int = 4, window: float = 0.125, ranges: int = 40, block: int = 131_072, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, compared): the k nearest found of each row that queries selects, and how many rows it was compared with. ranges is 255 at most."""
    spark = vectors.sparkSession
    kind = "float" if "array<float>" in vectors.select(embedding).schema[0].dataType.simpleString() else "double"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(f"array<{kind}>").alias("v")).filter("vec_id is not null and size(v) > 0")
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(sound)
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, compared long")
    width, total = common["n"], common["count"]
    rows = rows.filter(F.size("v") == width)
    share = min(1.0, SAMPLE / total)
    # SAMPLE rows, give or take their hashes
    sample = rows.filter(F.shiftrightunsigned(F.xxhash64("vec_id"), 11) / F.lit(float(1 << 53)) <= share).select("v").toArrow()["v"].combine_chunks()
    if not len(sample):
        sample = rows.select("v").limit(1).toArrow()["v"].combine_chunks()
    index = Curves(_matrix(sample, width), curves, dims, ranges)
    reach = int(np.ceil(window * ranges))
    # how many pieces each range of the first curve is split into
    size = min(block, max(LEAST, -(-total // (2 * partitions(spark)))))
    held = np.bincount(index.ranges(_matrix(sample, width))[:, 0], minlength=len(index.cuts[0]) + 1) / len(sample) * total
    before = np.concatenate([[0.0], np.cumsum(held)])
    # small neighbouring ranges share a piece; a crowded range has several
    piece_of = (before[:-1] // size).astype(np.int64)
    split = np.maximum(1, np.ceil(held / size)).astype(np.int64)
    offset = np.zeros(len(held), np.int64)
    for r in range(1, len(held)):
        offset[r] = offset[r - 1] if split[r] == split[r - 1] == 1 and piece_of[r] == piece_of[r - 1] else offset[r - 1] + split[r - 1]
    pieces = int(offset[-1] + split[-1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                r = index.ranges(_matrix(b.column(1), width))
                ids = b.column(0).to_numpy()
                piece = offset[r[:, 0]] + (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % split[r[:, 0]]
                yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), *b.columns, pa.array([x.tobytes() for x in r.astype(np.uint8)], pa.binary())], names=["piece", "vec_id", "v", "r"])

    placed = f"piece int, vec_id long, v array<{kind}>, r binary"
    data = rows.mapInArrow(place, placed).select("piece", F.lit(0).alias("side"), "vec_id", "v", "r")
    asks = rows.filter(queries).mapInArrow(place, placed).select(F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece"), F.lit(1).alias("side"), "vec_id", "v", "r")
    both = data.unionByName(asks).repartition(min(pieces, max(partitions(spark), -(-total // block))), "piece").sortWithinPartitions("piece", "side")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, gathered, piece = None, [], None
        for whole in batches:
            p, side = whole.column(0).to_numpy(), whole.column(1).to_numpy()
            cuts = np.flatnonzero((p[1:] != p[:-1]) | (side[1:] != side[:-1])) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(p)], strict=True):
                if a == z:
                    continue
                if p[a] != number:
                    number, gathered, piece = p[a], [], None
                if side[a] == 0:
                    gathered.append(whole.slice(a, z - a))
                    continue
                if not gathered and piece is None:
                    continue  # a piece without rows
                if piece is None:
                    piece, gathered = _Piece(gathered, width, curves, k), []
                step = max(1, PAIRS // len(piece.ids))
                for s in range(a, z, step):
                    b = whole.slice(s, min(step, z - s))
                    at = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint8).reshape(-1, curves)
                    found = piece.nearest(b.column(2).to_numpy(), _matrix(b.column(3), width), at, reach)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "vec_id", "score", "compared"])

    found = both.mapInArrow(meet, "query_id long, vec_id long, score double, compared long")
    merged = found.repartition(partitions(spark), "query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"), F.sum("compared").alias("here"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = merged.withColumn("rank", F.row_number().over(order)).withColumn("compared", F.sum("here").over(Window.partitionBy("query_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "compared")
