"""The session rule on a stream: events come late and out of order, sessions leave when nothing can join them any more.

Threads are dealt into buckets, and a bucket's state is what came but isn't due, and the walks of its threads so far: a step
reads and writes the state of many threads at once, as a call for each of them costs more than its events. An event is due
once the watermark has passed it: then all events before it are here, and its thread's walk takes it in order. A session
leaves when the walk begins the next one, or when the watermark has passed its end by the hard gap; a bucket has one timer,
for the first of these. Events behind the watermark on arrival change nothing that has left; they come out as rows of their
own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.conversations import GAP, HARD_GAP, MIN_SESSION_TOKENS, SESSION_CAP
from ..sources.shared import fresh

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Buckets of threads. A stream keeps the number that it began with.
BUCKETS = 512
OUT = "kind string, thread_id long, session_no long, n long, a long, b long, unit_id long"


class Sessions(StatefulProcessor):
    """sessions() of operators.conversations, one event after another. Seconds in, seconds out; timers are in milliseconds."""

    def __init__(self, gap: int = GAP, hard_gap: int = HARD_GAP, least: int = MIN_SESSION_TOKENS, cap: int = SESSION_CAP):
        self.gap, self.hard_gap, self.least, self.cap = gap, hard_gap, least, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "thread_id long, start_ts long, unit_id long, end_ts long, tokens long")
        self.walks = handle.getListState("walks", "thread_id long, number long, held long, n long, a long, b long")
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, at: int | None, timer: int | None) -> None:
        """The bucket's timer at `at` instead of `timer`."""
        if at == timer:
            return
        if timer is not None:
            self.handle.deleteTimer(timer)
        if at is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        columns = ["thread_id", "start_ts", "unit_id", "end_ts", "tokens"]
        every = pd.concat([part.loc[part["unit_id"].notna(), columns] for part in rows]).astype({"thread_id": "Int64"} | dict.fromkeys(columns[1:], "int64"))
        behind = every["start_ts"] * 1000 < mark
        rows_of = lambda some: [(None if r[0] is pd.NA else r[0], *r[1:]) for r in some.itertuples(index=False, name=None)]
        new = rows_of(every[~behind])
        if new:
            self.pending.appendList(new)
            timer = self.timer.get()[0] if self.timer.exists() else None
            at = min(r[1] for r in new) * 1000 + 1
            if timer is None or at < timer:
                self._wake(at, timer)
        if behind.any():
            yield self._rows([("late", thread, None, 1, start, end, unit) for thread, start, unit, end, _ in rows_of(every[behind])])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, out = timerValues.getCurrentWatermarkInMs(), []
        due, rest = [], []
        for r in self.pending.get() if self.pending.exists() else ():
            (due if r[1] * 1000 < mark else rest).append(tuple(r))
        walks = {r[0]: tuple(r[1:]) for r in self.walks.get()} if self.walks.exists() else {}
        due.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1:]))  # no thread is a thread
        at = 0
        while at < len(due):
            thread = due[at][0]
            number, tokens, n, a, b = walks.get(thread, (0, 0, 0, 0, 0))
            while at < len(due) and due[at][0] == thread:
                _, start, _, end, size = due[at]
                # n is 0 where the session before has left by a timer: whatever comes is over the hard gap behind it
                new = not n or start - b > self.hard_gap or (start - b > self.gap and tokens >= self.least) or tokens + size > self.cap
                if new:
                    if n:
                        out.append(("session", thread, number, n, a, b, None))
                    number, tokens, n, a = number + 1, 0, 0, start
                tokens, n, b = tokens + size, n + 1, end
                at += 1
            walks[thread] = number, tokens, n, a, b
        ends = []
        for thread, (number, _, n, a, b) in walks.items():
            if n and (b + self.hard_gap) * 1000 < mark:
                out.append(("session", thread, number, n, a, b, None))
                walks[thread] = number, 0, 0, a, b
            elif n:
                ends.append(b + self.hard_gap)
        if rest:
            self.pending.put(rest)
        else:
            self.pending.clear()
        if walks:
            self.walks.put([(thread, *w) for thread, w in walks.items()])
        at = min([*(r[1] for r in rest), *ends], default=None)
        self._wake(None if at is None else at * 1000 + 1, expiredTimerInfo.getExpiryTimeInMs())
        if out:
            yield self._rows(out)

    def close(self) -> None:
        pass

    @staticmethod
    def _rows(rows: list[tuple]) -> pd.DataFrame:
        names = [x.split()[0] for x in OUT.split(", ")]
        return pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in names[1:]})


def session_stream(units: DataFrame, delay: str, buckets: int = BUCKETS, **rule: int) -> DataFrame:
    """A stream of units (thread_id, unit_id, start_ts, end_ts, tokens) to rows of two kinds: `session` (thread_id, session_no, n, a, b) and `late` (thread_id, unit_id, a, b). start_ts in seconds; delay: how far the watermark stays behind the latest event."""
    timed = units.withColumn("_at", F.timestamp_seconds("start_ts")).withWatermark("_at", delay)
    # without the watermark's own column Spark passes late rows on, and the processor decides
    plain = timed.select(F.pmod(F.xxhash64("thread_id"), F.lit(buckets)).cast("int").alias("bucket"), "thread_id", "unit_id", "start_ts", "end_ts", F.col("tokens").cast("long").alias("tokens"))
    return plain.groupBy("bucket").transformWithStateInPandas(statefulProcessor=Sessions(**rule), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


class Replay:
    """A stream over deliveries, one a micro-batch in the order in which they are made. It may stop after any of them and go on from its checkpoint; a batch that runs again writes its own folder again."""

    def __init__(self, spark: SparkSession, schema, delay: str, **rule: int):
        self.spark, self.schema, self.delay, self.rule = spark, schema, delay, rule
        self.due, self.made, self.taken = [], 0, 0
        self.source, self.sink, self.state = fresh(spark, "feed"), fresh(spark, "sessions"), fresh(spark, "stream")

    def deliver(self, part: DataFrame) -> None:
        self.due.append(part.select(*self.schema.names))

    def close(self) -> None:
        """A last delivery, of no thread, that moves the watermark past every open session."""
        far = {"start_ts": 1 << 33, "end_ts": 1 << 33}
        self.deliver(self.spark.range(1).select(*(F.lit(far.get(f.name)).cast(f.dataType).alias(f.name) for f in self.schema)))

    def run(self) -> None:
        """Take what has been delivered and not taken yet. A delivery is written by many tasks, so it lies in many files; the next is written once it has been taken, and what lies there is one batch."""
        while self.due or self.made > self.taken:
            if self.made == self.taken:
                self.due[0].write.mode("overwrite").parquet(f"{self.source}/part={self.made}")
                self.due.pop(0)
                self.made += 1
            self._take(last=not self.due)
            self.taken = self.made

    def _take(self, last: bool) -> None:
        # a batch without data, in which timers go off, is for the last delivery: they go off in the next one's batch else
        conf = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": str(last).lower()}
        before = {k: self.spark.conf.get(k) for k in conf}
        for k, v in conf.items():
            self.spark.conf.set(k, v)
        try:
            stream = self.spark.readStream.schema(self.schema).option("recursiveFileLookup", True).parquet(self.source)
            write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{self.sink}/batch={number}")
            run = session_stream(stream, self.delay, **self.rule).writeStream.option("checkpointLocation", self.state).foreachBatch(write).trigger(availableNow=True).start()
            run.awaitTermination()
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(OUT).option("recursiveFileLookup", True).parquet(self.sink)

    def sessions(self) -> DataFrame:
        return self.rows().filter("kind = 'session'").select("thread_id", "session_no", "n", "a", "b")

    def late(self) -> DataFrame:
        return self.rows().filter("kind = 'late'").select("thread_id", "unit_id", F.col("a").alias("start_ts"))


def replayed_sessions(spark: SparkSession, units: DataFrame, part: str, parts: int, delay: str, **rule: int) -> Replay:
    """The stream over units delivered in `parts` by the number in column part, and closed."""
    out = Replay(spark, units.drop(part).schema, delay, **rule)
    for k in range(parts):
        out.deliver(units.filter(F.col(part) == k).drop(part))
    out.close()
    out.run()
    return out
