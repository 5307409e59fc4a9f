"""N-gram Jaccard join: sets of word shingles as points of group counts, searched by count bounds, verified exactly.

A document is the set of its distinct shingles of `width` words (ASCII letters lower-cased; fewer words: the whole
sequence is the one shingle). Two documents link when 100 * |A & B| >= percent * |A | B|. The result has one row a
document with its component (the smallest doc_id that links reach) and the number of documents that it links with.

1. Equal texts fall together under one representative before any set is made, and texts of equal sets after. Sets are
   made once for keys and counts and again, for documents with a candidate only, to verify; they are too large to keep.
2. Shingles are hashed into groups. Linked sets differ in at most r shingles (r follows from the sizes), so of r + 1 or
   more groups one at least is the same in both: the contents of its group are the key under which two points meet.
   Sizes come in bands of ratio 1 : percent, so a pair shares the number of groups of the smaller one's band. Keys under
   which the same documents meet are one.
3. Under a key, points stand in an R-tree (packed by size and counts, each node with the upper corner of its points).
   The tree is met with itself: nodes fall out whose corners' summed minima cannot reach the overlap that a link needs,
   and pairs of points by their own. Of the pairs left only a spanning forest goes on; its components are clusters.
4. All links lie inside clusters. One over several chunks is parted first by finer points, which have an axis for some
   four to eight shingles: under 256 axes any two long documents pass, and their sets would go to each other's chunk.
5. Inside the clusters each document's set comes once; the pairs that pass the tree are verified on the sets, counted, and
   their spanning forest gives the components.

A crowded key or cluster is dealt into chunks, and each pair of chunks is a unit of work of its own, so no task holds
more than two chunks. No link is lost: every pair is verified or bounded out. A tree over all points at once would leave some
pairs of leaves to be met (a twelfth of all, see the README), which grows with the square of the documents; so trees stand
under the keys of step 2.

Results: one row a doc_id. Null and empty texts and texts of blanks have 0 shingles and link with nothing. Rows that
repeat a doc_id are one document (of different texts under one doc_id the one with the smallest digest counts). Rows
without a doc_id give one row without a component and link with nothing. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import digest128, discard, lower_ascii, mix, partitions, released, runs, slices, span_hashes, stored, text_bytes, unused, word_spans

#: Counts a point has. What sets do not share should be spread thin over them, or the bound lets too many pairs through.
AXES = 256
#: A count is one byte; what a set has above is summed up beside its point.
TOP = 255
#: Points of a leaf, and nodes of a node above.
FAN = 16
#: Pairs of nodes whose bounds are taken at once.
BLOCK = 2048
#: Ids of at most this many documents are broadcast (8 MB), and rows of their places in clusters; more meet their rows by a shuffle.
BROADCAST_IDS, BROADCAST_PLACES = 1_000_000, 250_000
#: A chunk of a crowded key has so many points at most, about; one of a cluster so many sets and shingles.
CHUNK_POINTS, CHUNK_SETS, CHUNK_SHINGLES = 1024, 512, 1 << 18
#: Shingles for which a finer point has an axis, at least, and axes of the finer points of a chunk.
COARSE, CHUNK_AXES = 4, 1 << 22
#: Columns of shingles that are multiplied at once.
COLUMNS = 2048


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after another, and each text's offsets in them."""
    raw, offsets = text_bytes(texts)
    raw = lower_ascii(raw)
    begins, ends, first = word_spans(raw, offsets)
    words = span_hashes(raw, begins, ends)
    n = np.diff(first)
    count = np.where(n == 0, 0, np.maximum(n - width + 1, 1))
    upto = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), count)
    start = np.repeat(first[:-1] - upto[:-1], count) + np.arange(upto[-1])
    value = np.zeros(len(doc), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            there = start + k < first[1:][doc]
            word = words[np.minimum(start + k, max(len(words) - 1, 0))] if len(words) else value
            value = mix(value * np.uint64(3) + np.where(there, word, np.uint64(k)) + np.uint64(1))
    sets = [np.unique(value[a:b]) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
    return (np.concatenate(sets) if sets else value), np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)


class Bands:
    """Bands of set sizes and, for each, into how many groups the shingles go."""

    def __init__(self, percent: int):
        self.percent, self.low, self.radius = percent, [1], []

    def band(self, size: int) -> int:
        while self.low[-1] <= size:
            self.low.append(self.low[-1] * 100 // self.percent + 1)
        return int(np.searchsorted(self.low, size, side="right")) - 1

    def groups(self, band: int) -> tuple[int, int]:
        """(shingles in which linked sets may differ, groups) where the smaller set is in this band."""
        self.band(self.low[band])
        top = self.low[band + 1] - 1
        r = (100 - self.percent) * (top + top * 100 // self.percent) // (100 + self.percent)
        return r, r + 2 + r // 25

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """One key for each group with shingles, in the set's own band and the one below. Where so many groups are empty that these alone could agree, the empty ones are keys too."""
        own, out = self.band(len(shingles)), []
        sums = np.zeros(len(shingles) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(mix(shingles), out=sums[1:])
            for band in {own, max(own - 1, 0)}:
                r, n = self.groups(band)
                cut = np.searchsorted(shingles, (np.arange(1, n, dtype=np.uint64)) * np.uint64((1 << 64) // n))
                cut = np.concatenate([[0], cut, [len(shingles)]])
                full = np.diff(cut) > 0
                if n - int(full.sum()) >= n - r:
                    full[:] = True
                g = np.flatnonzero(full)
                size = (cut[g + 1] - cut[g]).astype(np.uint64)
                out.append(mix((sums[cut[g + 1]] - sums[cut[g]]) + mix(size + np.uint64(1 << 20) * (g.astype(np.uint64) + np.uint64(band << 24)))))
        return np.concatenate(out).view(np.int64)


def counts_of(shingles: np.ndarray) -> np.ndarray:
    return np.minimum(np.bincount((shingles & np.uint64(AXES - 1)).astype(np.int64), minlength=AXES), TOP).astype(np.uint8)


def needed(a, b, percent: int):
    """The overlap from which sets of sizes a and b link."""
    return -(-percent * (a + b) // (100 + percent))


POINT = ["counts", "n", "above"]


def _lists(upto: np.ndarray, x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.asarray(upto, np.int32)), pa.array(x.view(np.int64)))


def _points(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc, keys, counts, n, above, s1, s2) of each row of (doc, text): the keys it is searched by, its group counts, the size of its set, how many shingles the counts leave out, and 128 bits of the set (of empty sets: the doc)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for whole in batches:
            for b in slices(whole, 1):
                sets, upto = shingle_sets(b.column(1), width)
                each = [sets[x:y] for x, y in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
                keys = [bands.keys(x) if len(x) else np.zeros(0, np.int64) for x in each]
                counts = [counts_of(x) for x in each]
                n = np.diff(upto)
                above = n - np.array([c.sum(dtype=np.int64) for c in counts])
                with np.errstate(over="ignore"):
                    halves = [np.concatenate([[np.uint64(0)], np.cumsum(mix(sets + np.uint64(salt)), dtype=np.uint64)]) for salt in (0, 0xC2B2AE3D27D4EB4F)]
                    s1, s2 = ((h[upto[1:]] - h[upto[:-1]]).view(np.int64) for h in halves)
                s1 = np.where(n == 0, b.column(0).to_numpy(), s1)
                found = _lists(np.concatenate([[0], np.cumsum([len(k) for k in keys])]), np.concatenate(keys))
                yield pa.RecordBatch.from_arrays([b.column(0), found, pa.array([c.tobytes() for c in counts], pa.binary()), pa.array(n), pa.array(above), pa.array(s1), pa.array(s2)], names=["doc", "keys", *POINT, "s1", "s2"])
        released()

    return docs.mapInArrow(run, "doc long, keys array<long>, counts binary, n long, above long, s1 long, s2 long")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc, shingles) of each row of (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                sets, upto = shingle_sets(b.column(1), width)
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(upto, sets)], names=["doc", "shingles"])

        released()

    return docs.mapInArrow(run, "doc long, shingles array<long>")


def _finer(sets: DataFrame, percent: int) -> DataFrame:
    """(root, level, doc, n, counts, above) of each row of (root, doc, shingles): counts with an axis for COARSE shingles of the smallest set of a level, whose sets are of 2^level shingles and more, at the set's own level, and at the one below where a link may reach there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            upto = lists.offsets.to_numpy().astype(np.int64)
            shingles = lists.values.to_numpy().view(np.uint64)
            row, level, counts, above = [], [], [], []
            for k, (x, y) in enumerate(zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)):
                own = max(y - x, 1).bit_length() - 1
                for at in (own, own - 1) if percent * (y - x) <= 100 * ((1 << own) - 1) else (own,):
                    axes = max((1 << max(at, 0)) // COARSE, 1)
                    each = np.bincount((shingles[x:y] & np.uint64(axes - 1)).astype(np.int64), minlength=axes)
                    row.append(k)
                    level.append(at)
                    counts.append(np.minimum(each, TOP).astype(np.uint8).tobytes())
                    above.append(int(np.maximum(each - TOP, 0).sum()))
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), pa.array(level, pa.int32()), b.column(1).take(row), pa.array(np.diff(upto)).take(row), pa.array(counts, pa.binary()), pa.array(above, pa.int64())], names=["root", "level", "doc", "n", "counts", "above"])

    return sets.mapInArrow(run, "root long, level int, doc long, n long, counts binary, above long")


def _counts(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, AXES)


class Tree:
    """An R-tree over points, met with itself. With sides, only pairs of points of different sides are looked for."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, above: np.ndarray, side: np.ndarray | None = None):
        self.sides = side is not None and len(side) > 0 and bool((side != side[0]).any())
        side = side if self.sides else np.zeros(len(sizes), np.int64)
        self.order = np.lexsort((counts[:, -1], counts[:, 0], sizes, side))
        # upper corner, least and most size, what the counts leave out, lowest and highest side: of points, then of the nodes above
        self.levels = [tuple(x[self.order] for x in (counts, sizes, sizes, above, side, side))]
        merge = (np.maximum, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum)
        while len(self.levels[-1][1]) > FAN:
            at = np.arange(0, len(self.levels[-1][1]), FAN)
            self.levels.append(tuple(f.reduceat(x, at, axis=0) for f, x in zip(merge, self.levels[-1], strict=True)))

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of points, each once, whose summed minima reach the overlap that a link needs."""
        stack = [(len(self.levels) - 1, *np.triu_indices(len(self.levels[-1][1])))]
        while stack:
            level, i, j = stack.pop()
            if len(i) > BLOCK:
                stack.append((level, i[BLOCK:], j[BLOCK:]))
                i, j = i[:BLOCK], j[:BLOCK]
            corner, least, most, rest, low, high = self.levels[level]
            good = (percent * least[j] <= 100 * most[i]) & (percent * least[i] <= 100 * most[j])
            if self.sides:
                good &= (low[i] != high[i]) | (low[j] != high[j]) | (low[i] != low[j])
            if not level:
                good &= i != j
            i, j = i[good], j[good]
            good = np.minimum(corner[i], corner[j]).sum(1, dtype=np.int64) + np.minimum(rest[i], rest[j]) >= needed(least[i], least[j], percent)
            i, j = i[good], j[good]
            if not len(i):
                continue
            if not level:
                yield self.order[i], self.order[j]
                continue
            child = np.arange(FAN)
            x = np.broadcast_to((i[:, None] * FAN + child)[:, :, None], (len(i), FAN, FAN)).ravel()
            y = np.broadcast_to((j[:, None] * FAN + child)[:, None, :], (len(j), FAN, FAN)).ravel()
            on = (x <= y) & (y < len(self.levels[level - 1][1])) & (x < len(self.levels[level - 1][1]))
            stack.append((level - 1, x[on], y[on]))


class Forest:
    """Labels of 0 .. n - 1: the smallest number that the edges so far reach."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        while True:
            a, b = self.label[x], self.label[y]
            if (a == b).all():
                return
            low = np.minimum(a, b)
            np.minimum.at(self.label, a, low)
            np.minimum.at(self.label, b, low)
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.label[at], at


def overlaps(shingles: np.ndarray, upto: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Size of the intersection of sets x[k] and y[k] for each k; by products of 0/1 columns where many pairs share few sets, else by looking up the smaller set's shingles."""
    n = np.diff(upto)
    used = np.unique(np.concatenate([x, y]))
    place = np.full(len(n), -1)
    place[used] = np.arange(len(used))
    row = np.repeat(place, n)
    _, col = np.unique(shingles[row >= 0], return_inverse=True)
    row = row[row >= 0]
    shared = np.bincount(col) > 1
    row, col = row[shared[col]], (np.cumsum(shared) - 1)[col[shared[col]]]
    width = int(shared.sum())
    x, y = place[x], place[y]
    sizes = np.bincount(row, minlength=len(used))
    x, y = np.where(sizes[x] <= sizes[y], x, y), np.where(sizes[x] <= sizes[y], y, x)
    if 0.05 * len(used) ** 2 * width < 60.0 * sizes[x].sum():
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        both = np.zeros((len(used), len(used)))
        for a in range(0, width, COLUMNS):
            s, e = np.searchsorted(col, [a, a + COLUMNS])
            block = np.zeros((len(used), min(COLUMNS, width - a)), np.float32)
            block[row[s:e], col[s:e] - a] = 1
            both += block @ block.T
        return both[x, y].astype(np.int64)
    flat = row * max(width, 1) + col
    flat.sort()
    first = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(len(x), np.int64)
    step = np.cumsum(sizes[x]) // 1_000_000
    for k in np.unique(step):
        at = np.flatnonzero(step == k)
        size = sizes[x[at]]
        pair = np.repeat(np.arange(len(at)), size)
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        asked = flat[first[x[at]][pair] + inner] - (x[at] - y[at])[pair] * width
        hit = np.minimum(np.searchsorted(flat, asked), max(len(flat) - 1, 0))
        out[at] = np.bincount(pair[flat[hit] == asked], minlength=len(at)) if len(flat) else 0
    return out


def linked(shingles: np.ndarray, upto: np.ndarray, side: np.ndarray | None, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of sets that link, each once: those that pass the tree are verified."""
    n = np.diff(upto)
    row = np.repeat(np.arange(len(n)), n)
    counts = np.bincount(row * AXES + (shingles & np.uint64(AXES - 1)).astype(np.int64), minlength=len(n) * AXES).reshape(-1, AXES)
    above = np.maximum(counts - TOP, 0).sum(1)
    held = list(Tree(np.minimum(counts, TOP).astype(np.uint8), n, above, side).pairs(percent))
    if held:
        x, y = (np.concatenate(v) for v in zip(*held, strict=True))
        both = overlaps(shingles, upto, x, y)
        good = 100 * both >= percent * (n[x] + n[y] - both)
        yield x[good], y[good]


def _meetings(keys: DataFrame) -> DataFrame:
    """(key, doc, first) for keys that several documents have; first: the smallest of them. Reads rows sorted by key and doc, and remembers one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_doc, told = None, None, False
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0).to_numpy()
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            new[0] = last_key is None or key[0] != last_key
            run_of = np.cumsum(new) - 1 + (not new[0])
            starts = np.flatnonzero(new)
            begin = np.concatenate([[0], starts]) if not new[0] else starts
            size = np.diff(np.append(begin, len(key)))
            want = size[run_of] > 1
            if not new[0]:
                want[: size[0]] = True
            at = np.flatnonzero(want)
            docs = b.column(1)
            firsts = docs.take(pa.array(begin[run_of[at]]))
            if not new[0]:
                n0 = int((run_of[at] == 0).sum())
                firsts = pa.concat_arrays([pa.array([last_doc] * n0, pa.int64()), firsts.slice(n0)])
                if not told:  # the key's first row was the last of an earlier batch
                    yield pa.RecordBatch.from_arrays([pa.array([last_key], pa.int64()), pa.array([last_doc], pa.int64()), pa.array([last_doc], pa.int64())], names=["key", "doc", "first"])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(key[at]), docs.take(pa.array(at)), firsts], names=["key", "doc", "first"])
            if len(begin) > 1 or new[0]:
                last_doc, told = docs[int(begin[-1])].as_py(), int(size[-1]) > 1
            else:
                told = True
            last_key = key[-1]

    return keys.mapInArrow(run, "key long, doc long, first long")


def _bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose summed coordinate minima reach the needed overlap."""
    small = points.select("doc", *POINT)
    joined = pairs.join(small.toDF("a", "ca", "na", "ra"), "a").join(small.toDF("b", "cb", "nb", "rb"), "b").select("a", "b", "ca", "cb", "na", "nb", "ra", "rb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                na, nb, ra, rb = (b.column(k).to_numpy() for k in range(4, 8))
                overlap = np.minimum(_counts(b.column(2)), _counts(b.column(3))).sum(1, dtype=np.int64) + np.minimum(ra, rb)
                yield b.select([0, 1]).filter(pa.array(overlap >= needed(na, nb, percent)))

    return joined.mapInArrow(run, "a long, b long")


def _chunked(rows: DataFrame, group: str, chunks: str) -> DataFrame:
    """rows of (group, doc, chunks, ...) with i, j and c: the document is in chunk c of its group, and chunk c meets chunk d in the work (least, greatest of both)."""
    dealt = rows.withColumn("c", F.pmod(F.xxhash64("doc"), F.col(chunks)).cast("int"))
    dealt = dealt.withColumn("d", F.explode(F.sequence(F.lit(0), F.col(chunks).cast("int") - 1)))
    return dealt.withColumn("i", F.least("c", "d")).withColumn("j", F.greatest("c", "d")).drop("d", chunks)


def _worked(rows: DataFrame, group: str, columns: list[str], work: Callable, schema: str) -> DataFrame:
    """work(table) for the rows of each (group, i, j); tables have the columns named, with c in front."""
    rows = rows.select(group, "i", "j", "c", *columns).repartition(partitions(rows.sparkSession), group, "i", "j").sortWithinPartitions(group, "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in runs(batches, 3):
            yield from work(unit.select(range(3, unit.num_columns)))

    return rows.mapInArrow(run, schema)


def _crowds(met: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the pairs that pass the tree under each key. met: (key, m, doc), m the documents of the key."""
    rows = _chunked(met.withColumn("chunks", F.ceil(F.col("m") / CHUNK_POINTS)).drop("m"), "key", "chunks").join(points.select("doc", *POINT), "doc")

    def work(unit: pa.Table) -> Iterator[pa.RecordBatch]:
        side, doc, n, above = (unit.column(k).to_numpy() for k in (0, 1, 3, 4))
        forest = Forest(len(doc))
        for x, y in Tree(_counts(unit.column(2)), n, above, side).pairs(percent):
            forest.add(x, y)
        x, y = forest.edges()
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(doc[x]), pa.array(doc[y])], names=["a", "b"])

    return _worked(rows, "key", ["doc", *POINT], work, "a long, b long")


def _parted(members: DataFrame, sets: DataFrame, percent: int, few: bool) -> DataFrame:
    """(doc, root) of the clusters into which finer points part those given, documents left alone not among them. members: (doc, root), broadcast if few."""
    points = stored(_finer(sets.join(F.broadcast(members) if few else members, "doc").select("root", "doc", "shingles"), percent).withColumn("cell", F.xxhash64("root", "level")).drop("root"), "finer")
    many = points.groupBy("cell").agg(F.greatest(F.ceil(F.count("*") / CHUNK_POINTS), F.ceil(F.sum(F.length("counts")) / CHUNK_AXES)).alias("chunks"))
    rows = _chunked(points.join(many, "cell"), "cell", "chunks")

    def work(unit: pa.Table) -> Iterator[pa.RecordBatch]:
        side, level, doc, n, above = (unit.column(k).to_numpy() for k in (0, 1, 2, 3, 5))
        for at in np.unique(level):  # one, unless two cells have one hash
            own = np.flatnonzero(level == at)
            counts = np.frombuffer(b"".join(unit.column(4).take(pa.array(own)).to_pylist()), np.uint8).reshape(len(own), -1)
            forest = Forest(len(own))
            for x, y in Tree(counts, n[own], above[own], side[own]).pairs(percent):
                forest.add(x, y)
            x, y = forest.edges()
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(doc[own[x]]), pa.array(doc[own[y]])], names=["a", "b"])

    near = stored(_worked(rows, "cell", ["level", "doc", "n", "counts", "above"], work, "a long, b long"), "near")
    out = components(near)
    discard(points, near)
    return out


def _verified(clusters: DataFrame, sizes: DataFrame, texts: Callable[[DataFrame], DataFrame], width: int, percent: int) -> DataFrame:
    """(a, b, links), stored: with b, a spanning forest of the links of each cluster; without, how many documents a links with. clusters: (doc, root); sizes: (doc, n, copies)."""
    ids = clusters.select("doc")
    count = ids.count()
    few = count <= BROADCAST_PLACES
    sets = stored(_sets(texts(F.broadcast(ids) if count <= BROADCAST_IDS else ids), width), "sets")
    chunks = F.greatest(F.ceil(F.count("*") / CHUNK_SETS), F.ceil(F.sum("n") / CHUNK_SHINGLES)).alias("chunks")
    members = clusters.join(sizes, "doc")
    large = stored(members.groupBy("root").agg(chunks).filter("chunks > 1").select("root"), "large")
    if not large.isEmpty():
        parted = _parted(clusters.join(large, "root"), sets, percent, few)
        members = clusters.join(large, "root", "left_anti").select("doc", "root").unionByName(parted).join(sizes, "doc")
    many = members.groupBy("root").agg(chunks)
    placed = members.join(many, "root").select("root", "doc", "copies", "chunks")
    rows = _chunked(sets.join(F.broadcast(placed) if few else placed, "doc"), "root", "chunks")

    def work(unit: pa.Table) -> Iterator[pa.RecordBatch]:
        side, doc, copies = (unit.column(k).to_numpy() for k in range(3))
        lists = unit.column(3).combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        upto = lists.offsets.to_numpy().astype(np.int64)
        shingles = lists.values.to_numpy()[upto[0] : upto[-1]].view(np.uint64)
        forest, links = Forest(len(doc)), np.zeros(len(doc))
        for x, y in linked(shingles, upto - upto[0], side, percent):
            forest.add(x, y)
            links += np.bincount(x, copies[y], len(doc)) + np.bincount(y, copies[x], len(doc))
        some = np.flatnonzero(links)
        if len(some):
            x, y = forest.edges()
            a, b = np.concatenate([doc[some], doc[x]]), np.concatenate([doc[some], doc[y]])
            counted = np.arange(len(a)) < len(some)
            n = np.concatenate([links[some], np.zeros(len(x))]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=counted), pa.array(n, mask=~counted)], names=["a", "b", "links"])

    out = stored(_worked(rows, "root", ["doc", "copies", "shingles"], work, "a long, b long, links long"), "links")
    discard(sets, large)
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(doc, root) for each document of an edge: root is the smallest document that edges reach. Labels fall to the smallest neighbour and then to their label's label, until none changes; rounds grow with the logarithm of the longest path."""
    both = stored(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y").unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y")).filter("x <> y")).distinct(), "edges")
    labels = stored(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("l")).select(F.col("x").alias("v"), "l"), "labels")
    held = labels
    while True:
        near = both.join(labels, both.y == labels.v).groupBy("x").agg(F.min("l").alias("m"))
        hooked = labels.join(near, labels.v == near.x, "left").select("v", F.least("l", "m").alias("l"), F.col("l").alias("old"))
        jump = labels.select(F.col("v").alias("w"), F.col("l").alias("ll"))
        after = stored(hooked.join(jump, hooked.l == jump.w, "left").select("v", F.least("l", "ll").alias("l"), (F.least("l", "ll") != F.col("old")).alias("moved")), "labels")
        discard(held)
        labels, held = after.select("v", "l"), after
        if after.filter("moved").isEmpty():
            discard(both)
            return labels.toDF("doc", "root")


def _joined(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """join() with the digest of the text that stands for each doc_id."""
    spark = docs.sparkSession
    named = docs.select(F.col(doc_id).cast("long").alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("digest", digest128(F.col("text")))
    rows = stored(named.groupBy("doc").agg(F.min("digest").alias("digest")), "rows")
    classes = stored(rows.filter("doc is not null").groupBy("digest").agg(F.min("doc").alias("rep"), F.count("*").alias("copies")), "classes")

    def texts(ids: DataFrame | None = None) -> DataFrame:
        """Of equal texts only the one with the smallest id goes on; rows that repeat an id and text come once (the join has already dealt them by both)."""
        some = named if ids is None else named.join(ids, "doc", "left_semi")
        once = some.join(classes, [some.doc == classes.rep, some.digest == classes.digest], "left_semi")
        return once.dropDuplicates(["doc", "digest"]).select("doc", "text")

    points = stored(_points(texts(), width, percent), "points")
    # texts of equal sets are one from here on, under the smallest of their documents
    made = classes.join(points.select(F.col("doc").alias("rep"), "n", "s1", "s2"), "rep")
    alike = made.groupBy("n", "s1", "s2").agg(F.min("rep").alias("head"), F.sum("copies").alias("together"))
    named_sets = stored(made.join(alike, ["n", "s1", "s2"]).select("digest", "rep", "n", "head", "together"), "named")
    sizes = named_sets.filter("rep = head").select(F.col("rep").alias("doc"), "n", F.col("together").alias("copies"))
    others = stored(named_sets.filter("rep <> head").select(F.col("rep").alias("doc")), "others")
    heads = points.join(F.broadcast(others) if others.count() <= BROADCAST_IDS else others, "doc", "left_anti")
    keys = heads.select(F.explode("keys").alias("key"), "doc").repartition(partitions(spark), "key").sortWithinPartitions("key", "doc")
    met = stored(_meetings(keys), "met")
    # keys under which the same documents meet are one; 128 bits and the count stand for the documents
    mark = [F.count("*").alias("m"), F.bit_xor(F.xxhash64("doc")).alias("x1"), F.bit_xor(F.xxhash64(F.lit("keepsake"), "doc")).alias("x2"), F.min("doc").alias("a"), F.max("doc").alias("b")]
    kept = stored(met.groupBy("key").agg(*mark).groupBy("m", "x1", "x2").agg(F.min("key").alias("key"), F.min("a").alias("a"), F.max("b").alias("b")), "lists")
    near = _bounded(kept.filter("m = 2").select("a", "b"), points, percent)
    crowds = _crowds(met.select("key", "doc").join(kept.filter("m > 2").select("key", "m"), "key"), points, percent)
    candidates = stored(near.unionByName(crowds), "candidates")
    discard(met, kept, others)
    clusters = components(candidates)
    found = _verified(clusters, sizes, texts, width, percent)
    discard(points, candidates)
    roots = components(found.filter("b is not null").select("a", "b"))
    links = found.filter("b is null").groupBy(F.col("a").alias("head")).agg(F.sum("links").alias("links"))
    placed = named_sets.join(roots.withColumnRenamed("doc", "head"), "head", "left").join(links, "head", "left")
    placed = placed.select("digest", "n", F.coalesce("root", "head").alias("root"), (F.col("together") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    size, known = F.coalesce("n", F.lit(0)).cast("long"), F.col("doc").isNotNull()
    return rows.join(placed, "digest", "left").select(
        F.col("doc").alias("doc_id"),
        size.alias("n_shingles"),
        F.when(known & (size > 0), F.col("root")).otherwise(F.col("doc")).alias("component_id"),
        F.when(known & (size > 0), F.col("links")).otherwise(0).cast("long").alias("n_links"),
        "digest",
    )


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of each row; see the module. n_links counts documents, copies too."""
    return _joined(docs, width=width, percent=percent, doc_id=doc_id, text=text).drop("digest")


def near_duplicates_dropped(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near copies: of each component the document with the smallest doc_id stays. Documents without words and rows without a doc_id all stay; where an id repeats with other texts, only the text that stood for it can go. Columns keep their names, whatever they are."""
    found = _joined(docs, width=width, percent=percent, doc_id=doc_id, text=text)
    gone, mark = unused(docs, "_gone"), unused(docs, "_mark")
    go = stored(found.filter("n_shingles > 0 and doc_id <> component_id").select(F.col("doc_id").alias(gone), F.col("digest").alias(mark)), "gone")
    own = digest128(F.coalesce(docs[text].cast("string"), F.lit("")))
    return docs.join(F.broadcast(go) if go.count() <= BROADCAST_IDS else go, (docs[doc_id].cast("long") == go[gone]) & (own == go[mark]), "left_anti")
