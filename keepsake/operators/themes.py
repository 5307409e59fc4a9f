"""Spherical k-means in every scope at once, a scope in one task or over many with the same result.

Starts are drawn as in k-means++, each row with a chance by its squared distance (1 - cosine) to the nearest start so far. The
draw is a race: a row's time is -ln(u) / weight, u a uniform number from the hash of its key and the turn, and the least time
wins. A race needs no total of the weights and merges by a minimum, so rows may lie in any number of tasks. Sums of a cluster
are taken in whole numbers of 2^-30, which no order of adding changes; so reruns agree, and so do both ways below.

Scopes of at most `whole` rows are clustered in one task each. The rows of larger ones are packed into blocks of at most BLOCK
rows, which fill many partitions; a turn joins the blocks with their scope's centres (k
vectors a scope, broadcast by Spark only under its own threshold), and sends on a row for each cluster and component of a
block. Scopes whose centres stand still drop out of the rounds.

Clusters by date hang on the order of their rows, so a scope is walked in it; but it is cut into chunks, and a chunk starts
from the centroids that the one before has left, as a table. The chunks of all scopes with one number go at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept
from .tables import ordered

#: Rows of a block, rows of a scope that one task takes, and the unit of sums (2^33 rows of a cluster fit a long).
BLOCK, WHOLE, UNIT = 2048, 50_000, float(1 << 30)
#: Facts of a scope that a task walks at once.
CHUNK = 20_000


def clusters_for(n: int, most: int) -> int:
    """round(sqrt(n / 3)) between 1 and most, at most n / 2."""
    return max(1, min(most, round(float(np.sqrt(n / 3))), n // 2))


def _uniform(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit hashes, other ones each turn (splitmix64)."""
    with np.errstate(over="ignore"):
        z = hashes.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (turn + 1)) % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _cosines(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row by row products, not a matrix product: what a row gets must not hang on the rows beside it. Rounded, so that ties are ties."""
    return np.stack([np.round((x * v).sum(1), 12) for v in c], 1)


def _racer(x: np.ndarray, hashes: np.ndarray, centres: np.ndarray, turn: int) -> tuple[bool, float, int, np.ndarray]:
    """(weightless, time, hash, vector) of the row that wins a turn. Where no row has a weight the draw is even."""
    u = -np.log(_uniform(hashes, turn))
    w = np.ones(len(x)) if not len(centres) else np.maximum(1 - _cosines(x, centres).max(1), 0) ** 2
    idle = w <= 0
    time = np.where(idle, u, u / np.where(idle, 1, w))
    first = np.flatnonzero(idle == idle.min())
    first = first[time[first] == time[first].min()]
    best = min(first, key=lambda i: (hashes[i], tuple(x[i])))
    return bool(idle[best]), float(time[best]), int(hashes[best]), x[best]


def _sums(x: np.ndarray, label: np.ndarray, k: int) -> np.ndarray:
    whole = np.rint(x * UNIT).astype(np.int64)
    out = np.zeros((k, x.shape[1]), np.int64)
    np.add.at(out, label, whole)
    return out


def _moved(centres: np.ndarray, sums: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Centres at their clusters' sums, unit length; a cluster without rows, or whose rows cancel out, keeps its centre."""
    out = centres.copy()
    for j in np.flatnonzero(filled):
        s = sums[j] / UNIT
        n = np.sqrt((s * s).sum())
        if n > 0:
            out[j] = s / n
    return out


def in_one_task(x: np.ndarray, hashes: np.ndarray, most: int, rounds: int) -> np.ndarray:
    """The label of each row of one scope. x: unit vectors."""
    k = clusters_for(len(x), most)
    c = np.zeros((0, x.shape[1]))
    for turn in range(k):
        c = np.vstack([c, _racer(x, hashes, c, turn)[3]])
    for _ in range(rounds - 1):
        label = _cosines(x, c).argmax(1)
        new = _moved(c, _sums(x, label, k), np.bincount(label, minlength=k) > 0)
        if (new == c).all():
            break
        c = new
    return _cosines(x, c).argmax(1)


def _values(lists: pa.ListArray, k: int) -> np.ndarray:
    return lists[k].values.to_numpy(zero_copy_only=False)


def _over(blocks: DataFrame, centres: DataFrame, ddl: str, schema: pa.Schema, each: Callable[[int, np.ndarray, np.ndarray, np.ndarray], list[tuple]]) -> DataFrame:
    """The rows that `each` makes of a block (its scope, its hashes, its vectors, its scope's centres)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                h, made = _values(b["h"], k), b["made"][k].as_py()
                x = _values(b["x"], k).reshape(len(h), -1)
                c = _values(b["c"], k).reshape(made, x.shape[1])
                out = each(b["g"][k].as_py(), h, x, c)
                yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return blocks.select("g", "h", "x").join(centres.select("g", "made", "c"), "g").mapInArrow(run, ddl)


def _blocks(rows: DataFrame, width: int) -> DataFrame:
    """(g, keys, h, x) of rows (g, key, h, x): up to BLOCK rows of a scope, their vectors end to end. Rows go to partitions by ranges of scope and hash, so a large scope fills many."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = b["g"].to_numpy()
            runs = np.concatenate([[0], np.flatnonzero(np.diff(g)) + 1, [len(g)]])
            cuts = np.concatenate([*(np.arange(a, z, BLOCK) for a, z in zip(runs, runs[1:])), [len(g)]]).astype(np.int32)
            lists = lambda values, each=1: pa.ListArray.from_arrays(pa.array(cuts * each), values)
            yield pa.RecordBatch.from_arrays([pa.array(g[cuts[:-1]]), lists(b["key"]), lists(b["h"]), lists(b["x"].flatten(), width)], names=["g", "keys", "h", "x"])

    schema = rows.select("g", F.array("key").alias("keys"), F.array("h").alias("h"), "x").schema
    return rows.repartitionByRange("g", "h").sortWithinPartitions("g", "h").select("g", "key", "h", "x").mapInArrow(pack, schema)


def _starts(blocks: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """(g, made, c): the starts of each scope, end to end, and how many. A pass over the blocks for each of at most `most` turns."""
    k = F.greatest(F.lit(1), F.least(F.lit(most), F.rint(F.sqrt(F.col("n") / 3)), F.floor(F.col("n") / 2))).cast("int")
    centres = kept(sizes.select("g", k.alias("k"), F.lit(0).alias("made"), F.array().cast("array<double>").alias("c")), "starts")
    vector = pa.list_(pa.float64())
    schema = pa.schema([("g", pa.int64()), ("idle", pa.bool_()), ("time", pa.float64()), ("h", pa.int64()), ("v", vector)])
    for turn in range(most):
        open_ = centres.filter(F.col("made") < F.col("k"))
        if open_.isEmpty():
            break
        won = _over(blocks, open_, "g long, idle boolean, time double, h long, v array<double>", schema, lambda g, h, x, c, turn=turn: [(g, *_racer(x, h, c, turn))])
        best = won.groupBy("g").agg(F.min(F.struct("idle", "time", "h", "v"))["v"].alias("v"))
        added = F.col("v").isNotNull()
        centres = kept(centres.join(best, "g", "left").select("g", "k", (F.col("made") + added.cast("int")).alias("made"), F.when(added, F.concat("c", "v")).otherwise(F.col("c")).alias("c")), "starts")
    return centres.select("g", "made", "c")


def _settled(blocks: DataFrame, centres: DataFrame, width: int, rounds: int) -> DataFrame:
    """(g, made, c): centres after the rounds. Partial sums of blocks merge by scope and component, k vectors a scope in all."""
    ints, flat = pa.int64(), "g long, made int, c array<double>"

    def partial(g: int, h: np.ndarray, x: np.ndarray, c: np.ndarray) -> list[tuple]:
        label = _cosines(x, c).argmax(1)
        sums = _sums(x, label, len(c))
        return [(g, int(j) * width + at, int(sums[j, at])) for j in np.unique(label) for at in range(width)]

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new, still = [], []
            for k in range(b.num_rows):
                c = _values(b["c"], k).reshape(-1, width)
                parts = b["sums"][k].values
                at = parts.field("at").to_numpy()
                sums = np.zeros(c.size, np.int64)
                sums[at] = parts.field("s").to_numpy()
                filled = np.bincount(at // width, minlength=len(c)) > 0
                moved = _moved(c, sums.reshape(c.shape), filled)
                new.append(moved.ravel())
                still.append(bool((moved == c).all()))
            yield pa.RecordBatch.from_arrays([b["g"], b["made"], pa.array(new, pa.list_(pa.float64())), pa.array(still, pa.bool_())], names=["g", "made", "c", "still"])

    done = []
    for _ in range(rounds - 1):
        sums = _over(blocks, centres, "g long, at long, s long", pa.schema([("g", ints), ("at", ints), ("s", ints)]), partial).groupBy("g", "at").agg(F.sum("s").alias("s"))
        lists = sums.groupBy("g").agg(F.collect_list(F.struct("at", "s")).alias("sums"))
        new = kept(centres.join(lists, "g").select("g", "made", "c", "sums").mapInArrow(shift, f"{flat}, still boolean"), "centres")
        done.append(new.filter("still").drop("still"))
        centres = new.filter("not still").drop("still")
        if centres.isEmpty():
            break
    for part in done:
        centres = centres.unionByName(part)
    return centres


def _rounds(rows: DataFrame, sizes: DataFrame, width: int, most: int, rounds: int) -> DataFrame:
    """(g, key, theme) of rows of large scopes."""
    blocks = kept(_blocks(rows, width), "blocks")
    centres = _settled(blocks, _starts(blocks, sizes, most), width, rounds)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            themes = [_cosines(_values(b["x"], k).reshape(-1, width), _values(b["c"], k).reshape(-1, width)).argmax(1) for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b["g"], b["keys"], pa.array(themes, pa.list_(pa.int64()))], names=["g", "keys", "themes"])

    both = blocks.join(centres, "g").select("g", "keys", "x", "c")
    out = both.mapInArrow(label, blocks.select("g", "keys", F.array(F.lit(0).cast("long")).alias("themes")).schema)
    return out.select("g", F.explode(F.arrays_zip("keys", "themes")).alias("e")).select("g", F.col("e.keys").alias("key"), F.col("e.themes").alias("theme"))


def theme_clusters(vectors: DataFrame, by: str, key: str, vector: str, most: int = 8, rounds: int = 30, seed: int = 0, whole: int = WHOLE) -> DataFrame:
    """(by, key, theme): spherical k-means in each scope, k = round(sqrt(n / 3)) between 1 and `most` and at most n / 2, until the clusters stand still or for `rounds` rounds.

    A scope without a name is one of its own. Rows whose vector is null, zero, of another length than the longest, or holds a
    null or a number that is not finite have no direction and no theme; they are left out. Rows that repeat a key each count and
    each get their row. `whole`: rows of a scope up to which one task clusters it; the result doesn't depend on it.
    """
    rows = vectors.select(F.col(by).alias("scope"), F.col(key).alias("key"), F.transform(vector, lambda v: v.cast("double")).alias("v"))
    sound = ~F.exists("v", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, v: s + v * v))
    rows = rows.filter(F.coalesce(sound, F.lit(False))).withColumn("n", length).filter((F.col("n") > 0) & (F.col("n") < float("inf")))
    rows = kept(rows.select("scope", "key", F.xxhash64("key", F.lit(seed)).alias("h"), F.transform("v", lambda v: v / F.col("n")).alias("x")), "directions")
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    rows = rows.filter(F.size("x") == F.lit(width))
    sizes = kept(rows.groupBy("scope").agg(F.count("*").alias("n")).withColumn("g", F.monotonically_increasing_id()), "sizes")
    scopes = sizes.select(F.col("scope").alias("_s"), "g", "n")
    rows = rows.join(scopes, F.col("scope").eqNullSafe(F.col("_s"))).select("g", "n", "key", "h", "x")
    large = sizes.filter(F.col("n") > whole)
    keyed = rows.select("g", "key", F.lit(0).cast("long").alias("theme")).schema

    def run(table: pa.Table) -> pa.Table:
        label = in_one_task(table["x"].combine_chunks().flatten().to_numpy().reshape(-1, width), table["h"].to_numpy(), most, rounds)
        return pa.table([table["g"], table["key"], pa.array(label, pa.int64())], names=["g", "key", "theme"])

    out = rows.filter(F.col("n") <= whole).select("g", "key", "h", "x").groupBy("g").applyInArrow(run, keyed)
    if not large.isEmpty():
        out = out.unionByName(_rounds(rows.filter(F.col("n") > whole), large, width, most, rounds))
    return out.join(scopes, "g").select(F.col("_s").alias(by), F.col("key").alias(key), "theme")


class _Centroids:
    """Sums of the clusters of a scope, in order of their making, in an array that doubles."""

    def __init__(self, width: int, numbers: list[int], sums: list):
        self.n, self.numbers = len(numbers), list(numbers)
        self.sums = np.zeros((max(16, 2 * self.n), width))
        if self.n:
            self.sums[: self.n] = np.asarray(sums, np.float64)
        self.norms = np.sqrt((self.sums * self.sums).sum(1))

    def nearest(self, v: np.ndarray, least: float) -> int | None:
        """The place of the nearest centroid at cosine least or more, of equal ones the last made."""
        if not self.n:
            return None
        norms = self.norms[: self.n]
        near = np.round(np.divide(self.sums[: self.n] @ v, norms, out=np.zeros(self.n), where=norms > 0), 12)
        best = self.n - 1 - int(near[::-1].argmax())
        return best if near[best] >= least else None

    def add(self, at: int, v: np.ndarray) -> None:
        self.sums[at] += v
        self.norms[at] = np.sqrt((self.sums[at] * self.sums[at]).sum())

    def make(self, number: int, v: np.ndarray) -> None:
        if self.n == len(self.sums):
            self.sums, self.norms = np.vstack([self.sums, np.zeros_like(self.sums)]), np.concatenate([self.norms, np.zeros_like(self.norms)])
        self.numbers.append(number)
        self.n += 1
        self.add(self.n - 1, v)


def dated_clusters(facts: DataFrame, least: float = 0.72, chunk: int = CHUNK) -> DataFrame:
    """(entity, id, cluster) of facts (entity, id, said_on, vec): in order of date and id a fact joins the cluster whose centroid is nearest, at cosine `least` or more, of equal ones the last made; else it starts one. Clusters are numbered from 0 as they are made.

    A fact whose vector is null, zero, of another length than the longest, or holds a null or a number that is not finite stands
    alone. Facts without a date come first; facts with equal date and id go by their vectors. A null entity is one of its own. A
    task holds `chunk` facts and the centroids of their entity; the result doesn't depend on `chunk`.
    """
    wide = F.transform("vec", lambda v: v.cast("double"))
    sound = F.coalesce(~F.exists("v", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, v: s + v * v))
    rows = facts.select("entity", "id", "said_on", wide.alias("v")).withColumn("n", F.when(sound, length))
    rows = rows.select("entity", "id", "said_on", F.when((F.col("n") > 0) & (F.col("n") < float("inf")), F.transform("v", lambda v: v / F.col("n"))).alias("v"))
    rows = kept(ordered(rows, ["entity", "said_on", "id", "v"], "k"), "facts")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    first = kept(rows.groupBy(F.col("entity").alias("_e")).agg(F.min("k").alias("g"), F.count("*").alias("n")), "entities")
    alone = F.when(F.size("v") == F.lit(width), F.col("v"))
    rows = kept(rows.join(first, F.col("entity").eqNullSafe(F.col("_e"))).select("g", "id", "k", F.floor((F.col("k") - F.col("g")) / chunk).alias("chunk"), alone.alias("v")), "chunks")
    chunks = -(-(first.agg(F.max("n")).first()[0] or 0) // chunk)
    schema = rows.select("g", "id", F.lit(True).alias("placed"), F.lit(0).cast("long").alias("cluster"), "v").schema

    def walk(part: pa.Table, left: pa.Table) -> pa.Table:
        """The clusters of a chunk's facts, and the centroids it leaves, with the next number in a row without a vector."""
        part, left = part.sort_by("k"), left.sort_by("cluster")
        before = list(zip(left["cluster"].to_pylist(), left["v"]))
        made = before[-1][0] if before else 0
        c = _Centroids(width, [n for n, v in before if v.is_valid], [v.values.to_numpy() for _, v in before if v.is_valid])
        out = []
        for v in part["v"]:
            x = v.values.to_numpy() if v.is_valid else None
            at = None if x is None else c.nearest(x, least)
            if at is not None:
                c.add(at, x)
                out.append(c.numbers[at])
                continue
            if x is not None:
                c.make(made, x)
            out.append(made)
            made += 1
        g = part["g"][0].as_py() if len(out) else None
        n = c.n + 1 if len(out) else 0  # a scope that has no more facts leaves nothing
        vectors = [None] * len(out) + [*c.sums[: c.n], None][:n]
        ids = pa.concat_arrays([*part["id"].chunks, pa.nulls(n, part["id"].type)])
        return pa.table([pa.array([g] * len(ids), pa.int64()), ids, pa.array([True] * len(out) + [False] * n, pa.bool_()), pa.array(out + [*c.numbers, made][:n], pa.int64()), pa.array(vectors, pa.list_(pa.float64()))], names=schema.names)

    state, done = None, []
    for k in range(chunks):
        part = rows.filter(F.col("chunk") == k).select("g", "id", "k", "v")
        state = rows.select("g", F.lit(0).cast("long").alias("cluster"), "v").limit(0) if state is None else state
        out = kept(part.groupBy("g").cogroup(state.groupBy("g")).applyInArrow(walk, schema), "walked")
        done.append(out.filter("placed").select("g", "id", "cluster"))
        state = out.filter("not placed").select("g", "cluster", "v")
    placed = rows.select("g", "id", F.lit(0).cast("long").alias("cluster")).limit(0)
    for part in done:
        placed = placed.unionByName(part)
    return placed.join(first, "g").select(F.col("_e").alias("entity"), "id", "cluster")
