"""Walks over threads that close a run at gaps and sizes, cut so that a long thread is walked by many tasks.

Rows are range-partitioned by thread and order, so a thread may lie in many partitions, and checkpointed, which keeps the
partitions. What a run's next close depends on is where the run began; a gap over the hard threshold is a barrier, behind
which nothing before it matters. So each partition is walked from every state that it may be entered with: the tokens held so
far, of which those over the cap act alike. Most of these walks meet after a close or two, all at a barrier. That gives a table
from the state at the partition's beginning to the closes in it and the state at its end. The tables, one a partition and
kept as ranges of states, are composed in order; then each partition is walked once more with its state known.

Inside a batch the next close after each row is found for all rows at once by binary search over running sums; the walk then
steps from close to close.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import folder

_START, _END, _TOKENS, _HARD, _PIECE = range(1, 6)


def checkpointed(df: DataFrame) -> DataFrame:
    """df in the shared folder, with its partitions and their order as they are."""
    spark: SparkSession = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder(spark))
    return df.checkpoint()


class _Batch:
    """The rows of a batch as arrays, with the next close after a close at each row."""

    def __init__(self, b: pa.RecordBatch, before: tuple | None, gap: float, least: int, cap: int):
        """before: (thread, end, piece) of the row before, None for the first of all."""
        n = b.num_rows
        thread, piece = b.column(0), b.column(_PIECE)
        number = lambda k: b.column(k).to_numpy(zero_copy_only=False)
        start, end, self.tokens = number(_START), number(_END), number(_TOKENS).astype(np.int64)
        self.fresh, same, self.gap = np.ones(n, bool), np.zeros(n, bool), np.zeros(n)
        differs = lambda c: ~pc.fill_null(pc.equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False) & ~(c[1:].is_null().to_numpy(zero_copy_only=False) & c[:-1].is_null().to_numpy(zero_copy_only=False))
        self.fresh[1:], same[1:], self.gap[1:] = differs(thread), ~differs(piece), start[1:] - end[:-1]
        if before is not None and before[0] == thread[0].as_py():
            self.fresh[0], same[0], self.gap[0] = False, before[2] is not None and before[2] == piece[0].as_py(), start[0] - before[1]
        # a unit of its own has no piece
        same &= ~piece.is_null().to_numpy(zero_copy_only=False)
        self.n, self.gap_over, self.least, self.cap = n, gap, least, cap
        self.sum = np.concatenate([[0], np.cumsum(self.tokens)])  # before each row
        self.hard = np.flatnonzero(self.fresh | (self.gap > number(_HARD)))
        self.open = np.flatnonzero(~same)
        self.soft = np.flatnonzero(~same & (self.gap > gap))
        at = np.arange(n)
        self.next = self.close(at + 1, -self.sum[:-1])
        self.last = (thread[n - 1].as_py(), end[n - 1], piece[n - 1].as_py())

    def close(self, at: np.ndarray, base: np.ndarray) -> np.ndarray:
        """The first row from `at` on that closes, n for none; base: tokens held less the sum before."""

        def first(rows, place):
            k = np.maximum(place, np.searchsorted(rows, at))
            return np.where(k < len(rows), rows[np.minimum(k, len(rows) - 1)], self.n) if len(rows) else np.full(len(at), self.n)

        full = first(self.open, np.searchsorted(self.sum[self.open + 1], self.cap - base, side="right"))
        far = first(self.soft, np.searchsorted(self.sum[self.soft], self.least - base, side="left"))
        return np.minimum(np.minimum(full, far), first(self.hard, np.zeros(len(at), np.int64)))


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p, last thread, end, piece) of a partition."""
    last = None
    for b in batches:
        if b.num_rows:
            last = b.slice(b.num_rows - 1)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), last.column(0), last.column(_END), last.column(_PIECE)], names=["p", "thread", "end", "piece"])


def _last_rows(walk: DataFrame) -> dict[int, tuple | None]:
    """For each partition with rows the (thread, end, piece) of the row before its first."""
    kind = walk.schema["_thread"].dataType.simpleString()
    before, last = {}, None
    for e in sorted(walk.mapInArrow(_edges, f"p int, thread {kind}, end double, piece string").collect(), key=lambda e: e.p):
        before[e.p], last = last, (e.thread, e.end, e.piece)
    return before


def gap_sizes(units: DataFrame, thread: str, order: list[str], end: str = "end_ts") -> DataFrame:
    """(thread, gap): seconds from the end of each unit to the start of the next of its thread, null at the first; a long thread is spread over tasks."""
    columns = {"_thread": F.col(thread), "_start": F.col("start_ts").cast("double"), "_end": F.col(end).cast("double"), "_tokens": F.lit(0).cast("long"), "_hard": F.lit(0.0), "_piece": F.lit(None).cast("string")}
    count = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col("_thread"), *(F.col(f"_by{k}") for k in range(len(order)))]
    rows = units.select(*(c.alias(k) for k, c in columns.items()), *(F.col(c).alias(f"_by{k}") for k, c in enumerate(order)))
    rows = checkpointed(rows.repartitionByRange(count, *by).sortWithinPartitions(*by).select(*columns))
    before = _last_rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior = before.get(TaskContext.get().partitionId())
        for b in batches:
            if b.num_rows:
                x = _Batch(b, prior, float("inf"), 0, 0)
                prior = x.last
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x.gap, mask=x.fresh)], names=[thread, "gap"])

    return rows.mapInArrow(run, f"{thread} {rows.schema['_thread'].dataType.simpleString()}, gap double")


def numbered_runs(units: DataFrame, thread: str, order: list[str], name: str, *, hard: Column, gap: float = float("inf"), least: int = 0, cap: int, piece: str | None = None, end: str = "end_ts", partitions: int | None = None) -> DataFrame:
    """units (thread, start_ts, end, tokens, ...) with a run number from 1 in each thread, in order. A gap over hard closes a run; one over gap does once the run holds `least` tokens; so does a unit that would lift it over cap. Rows of one piece, side by side, are parted by hard gaps only."""
    spark = units.sparkSession
    columns = {"_thread": F.col(thread), "_start": F.col("start_ts").cast("double"), "_end": F.col(end).cast("double"), "_tokens": F.col("tokens").cast("long"), "_hard": hard.cast("double"), "_piece": (F.col(piece) if piece else F.lit(None)).cast("string")}
    rows = units.select(*(c.alias(k) for k, c in columns.items()), F.struct(*units.columns).alias("_row"))
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col("_thread"), *(F.col("_row")[c] for c in order)]
    rows = checkpointed(rows.repartitionByRange(count, *by).sortWithinPartitions(*by))
    walk = rows.drop("_row")
    before = _last_rows(walk)

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()
        prior = before.get(p)
        held, closes, whole, begun = np.arange(cap + 2), np.zeros(cap + 2, np.int64), True, False
        for b in batches:
            if not b.num_rows:
                continue
            x = _Batch(b, prior, gap, least, cap)
            prior, begun = x.last, True
            states, of = np.unique(np.minimum(held, cap + 1), return_inverse=True)
            at = x.close(np.zeros(len(states), np.int64), states)
            n, base = np.zeros(len(states), np.int64), states.copy()
            while (go := at < x.n).any():
                n[go] = np.where(x.fresh[at[go]], 0, n[go] + 1)
                base[go] = -x.sum[at[go]]
                at[go] = x.next[at[go]]
            if x.fresh.any():
                whole, closes = False, np.zeros(cap + 2, np.int64)
            held, closes = (base + x.sum[-1])[of], closes + n[of]
        if begun:
            held = np.minimum(held, cap + 1)
            new = np.flatnonzero(np.concatenate([[True], (held[1:] != held[:-1]) | (closes[1:] != closes[:-1])]))
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([whole]), *(pa.array([v.tolist()], pa.list_(pa.int64())) for v in (new, closes[new], held[new]))], names=["p", "whole", "low", "closes", "held"])

    entered, number, held = {}, 1, 0
    for t in sorted(walk.mapInArrow(table, "p int, whole boolean, low array<long>, closes array<long>, held array<long>").collect(), key=lambda t: t.p):
        entered[t.p] = (number, held, before[t.p])
        k = int(np.searchsorted(t.low, held, side="right")) - 1
        number, held = (number if t.whole else 1) + t.closes[k], t.held[k]

    schema = units.withColumn(name, F.lit(0).cast("long")).schema

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = entered.get(TaskContext.get().partitionId())
        for b in batches:
            if not b.num_rows:
                continue
            number, held, prior = state
            x = _Batch(b, prior, gap, least, cap)
            at, closed, follow = int(x.close(np.zeros(1, np.int64), np.array([held]))[0]), [], x.next.tolist()
            while at < x.n:
                closed.append(at)
                at = follow[at]
            flags = np.zeros(x.n, np.int64)
            flags[closed] = 1
            total = np.cumsum(flags)
            # a thread's first row closes nothing: numbers begin at 1 there
            heads = np.flatnonzero(x.fresh)
            since = np.searchsorted(heads, np.arange(x.n), side="right")
            offset = np.concatenate([[number], 1 - total[heads]])[since]
            out = total + offset
            held = int(x.sum[-1] - x.sum[closed[-1]]) if closed else int(held + x.sum[-1])
            state = (int(out[-1]), min(held, cap + 1), x.last)
            row = b.column(b.num_columns - 1)
            yield pa.RecordBatch.from_arrays([*row.flatten(), pa.array(out, pa.int64())], names=schema.names)

    return rows.mapInArrow(final, schema)
