"""From messages to turns, sessions, windows and reply trees."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .walks import gap_sizes, numbered_runs

TURN_GAP = 300
GAP = 2700
HARD_GAP = 86_400
MIN_SESSION_TOKENS = 120
SESSION_CAP = 3000


def _islands(df: DataFrame, by: str, order: list[str], starts: Column, name: str) -> DataFrame:
    """Number runs of rows: a new run at every row where starts holds."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def with_predecessor(messages: DataFrame, thread: str = "thread_id", order: tuple[str, ...] = ("ts", "msg_id")) -> DataFrame:
    w = Window.partitionBy(thread).orderBy(*order)
    return messages.withColumn("previous_id", F.lag("msg_id").over(w)).withColumn("gap", F.col("ts") - F.lag("ts").over(w))


def turns(messages: DataFrame, thread: str = "thread_id", gap: int = TURN_GAP) -> DataFrame:
    """Messages with turn_no: runs of one author with at most `gap` seconds between messages."""
    w = Window.partitionBy(thread).orderBy("ts", "msg_id")
    new = F.lag("msg_id").over(w).isNull() | (F.lag("author").over(w) != F.col("author")) | (F.col("ts") - F.lag("ts").over(w) > gap)
    return _islands(messages.withColumn("_new", new), thread, ["ts", "msg_id"], F.col("_new"), "turn_no").drop("_new")


def turn_table(messages: DataFrame, thread: str = "thread_id", gap: int = TURN_GAP, text: str | None = None) -> DataFrame:
    """One row a turn: author, first and last time, messages, and with text the texts joined by ' / '."""
    each = turns(messages, thread, gap).groupBy(thread, "turn_no")
    aggs = [F.min("author").alias("author"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n_messages"), F.min(F.struct("ts", "msg_id"))["msg_id"].alias("first_msg")]
    if text:
        aggs.append(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "msg_id", F.col(text).alias("t")))), lambda s: s["t"]), " / ").alias("line"))
    return each.agg(*aggs)


def gap_sessions(messages: DataFrame, thread: str = "thread_id", gap: int = GAP) -> DataFrame:
    """Messages with session_no: a gap over `gap` seconds starts a new one."""
    w = Window.partitionBy(thread).orderBy("ts", "msg_id")
    far = F.lag("ts").over(w).isNull() | (F.col("ts") - F.lag("ts").over(w) > gap)
    return _islands(messages.withColumn("_new", far), thread, ["ts", "msg_id"], F.col("_new"), "session_no").drop("_new")


def sessions(units: DataFrame, thread: str = "thread_id", gap: int = GAP, hard_gap: int = HARD_GAP, least: int = MIN_SESSION_TOKENS, cap: int = SESSION_CAP) -> DataFrame:
    """units (thread, unit_id, start_ts, end_ts, tokens[, piece_of]) with session_no.

    A gap over hard_gap always closes a session; one over gap closes it once it holds `least` tokens; a unit that would
    lift it over cap opens the next, but pieces of one unit stay together.
    """
    piece = "piece_of" if "piece_of" in units.columns else None
    return numbered_runs(units, thread, ["start_ts", "unit_id"], "session_no", hard=F.lit(hard_gap), gap=gap, least=least, cap=cap, piece=piece)


def windows(units: DataFrame, session: list[str], target: int = 300, overlap: float = 0.15) -> DataFrame:
    """(session columns, window_no, unit_id, position): greedy windows of about target tokens on unit boundaries. A window is never empty, the next one repeats at most overlap * target tokens and always moves on. Sessions, bounded by their cap, pass through a task one after another."""
    rows = units.select(*session, "unit_id", "start_ts", "tokens")
    schema = rows.select(*session, F.lit(0).cast("long").alias("window_no"), "unit_id", F.lit(0).cast("int").alias("position")).schema

    def cut(ids: list, tokens: list) -> Iterator[tuple[int, int, int]]:
        at, number = 0, 0
        while at < len(ids):
            end, held = at, 0
            while end < len(ids) and (end == at or held + tokens[end] <= target):
                held += tokens[end]
                end += 1
            yield from ((number, ids[k], k - at) for k in range(at, end))
            if end == len(ids):
                break
            back, repeated = end, 0
            while back - 1 > at and repeated + tokens[back - 1] <= overlap * target:
                back -= 1
                repeated += tokens[back]
            at, number = back, number + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, tokens, types = None, [], [], None

        def flushed(out: list) -> None:
            out += [(*last, *w) for w in cut(ids, tokens)]

        for b in batches:
            types, out = [b.schema.field(c).type for c in session] + [pa.int64(), b.schema.field("unit_id").type, pa.int32()], []
            for *key, unit, t in zip(*(b.column(c).to_pylist() for c in (*session, "unit_id", "tokens")), strict=True):
                if key != last:
                    if ids:
                        flushed(out)
                    last, ids, tokens = key, [], []
                ids.append(unit)
                tokens.append(t)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=schema.names)
        if ids:
            out = []
            flushed(out)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=schema.names)

    return rows.repartition(*session).sortWithinPartitions(*session, "start_ts", "unit_id").mapInArrow(run, schema)


def bursts(units: DataFrame, thread: str = "thread_id", cap: int = 4000, shortest: int = 1800, longest: int = 43_200) -> DataFrame:
    """units with burst_no: a gap over the thread's own threshold (mean and deviation of its gaps together, within bounds) or a unit that would lift the burst over cap starts a new one."""
    most = gap_sizes(units, thread, ["start_ts", "unit_id"]).groupBy(F.col(thread).alias("_t")).agg(F.least(F.greatest(F.avg("gap") + F.stddev_pop("gap"), F.lit(shortest)), F.lit(longest)).alias("_most"))
    both = units.join(most, F.col(thread).eqNullSafe(F.col("_t")), "left").drop("_t")  # a thread of one unit has no gap
    return numbered_runs(both, thread, ["start_ts", "unit_id"], "burst_no", hard=F.coalesce("_most", F.lit(longest)), cap=cap).drop("_most")


def carried(bursts_: DataFrame, least: int = 400, thread: str = "thread_id") -> DataFrame:
    """(thread, burst_no, carried): how many whole bursts before each are repeated with it, as few as hold `least` tokens, else all. bursts_: (thread, burst_no, tokens), numbered from 1 without gaps."""
    w = Window.partitionBy(thread).orderBy("burst_no")
    before = F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = bursts_.withColumn("low", F.coalesce(before, F.lit(0)))
    # the latest burst that begins `least` tokens before: sums only rise, so it is the last within a range of the sum
    reach = Window.partitionBy(thread).orderBy("low").rangeBetween(Window.unboundedPreceding, -least)
    return s.select(thread, "burst_no", (F.col("burst_no") - F.coalesce(F.max("burst_no").over(reach), F.lit(1))).cast("long").alias("carried"))


def structure(messages: DataFrame, conversation: str = "thread_id", thread: str = "thread_id", always_chat: Column | None = None) -> DataFrame:
    """(conversation, n, branching, structure): tree if over 0.3 of consecutive pairs reply to something else than the message before; under three messages a chat only if in one thread without replies."""
    w = Window.partitionBy(conversation).orderBy("ts", "msg_id")
    previous = F.lag("msg_id").over(w)
    rows = messages.withColumn("_b", (previous.isNotNull() & F.col("parent_id").isNotNull() & (F.col("parent_id") != previous)).cast("int"))
    if always_chat is not None:
        rows = rows.withColumn("_chat", always_chat)
    each = rows.groupBy(conversation).agg(F.count("*").alias("n"), F.sum("_b").alias("branching"), F.count_distinct(thread).alias("_threads"), F.count("parent_id").alias("_parents"), *([F.bool_or("_chat").alias("_chat")] if always_chat is not None else []))
    small = F.when((F.col("_threads") == 1) & (F.col("_parents") == 0), "chat").otherwise("tree")
    kind = F.when(F.col("n") < 3, small).when(F.col("branching") / (F.col("n") - 1) > 0.3, "tree").otherwise("chat")
    if always_chat is not None:
        kind = F.when(F.col("_chat"), "chat").otherwise(kind)
    return each.select(conversation, "n", F.col("branching").cast("long").alias("branching"), kind.alias("structure"))


def reply_paths(messages: DataFrame, conversation: str = "thread_id") -> DataFrame:
    """messages with depth and path: the (ts, msg_id) from the root down, so that sorting by it is preorder. msg_id is unique in a conversation; messages whose parent isn't in it are roots. Each round a message's path takes on the path of the message at its upper end, so depth needs rounds of its logarithm; what hangs on a cycle of replies has no root and isn't returned."""
    spark = messages.sparkSession
    own = messages.select(conversation, "msg_id", "parent_id", "ts")
    known = own.select(F.col(conversation).alias("_c"), F.col("msg_id").alias("_p"))
    most = own.groupBy(F.col(conversation).alias("_m")).agg(F.count("*").alias("_most"))
    tied = own.join(known, (own[conversation] == known._c) & (own.parent_id == known._p), "left")
    tied = tied.join(most, tied[conversation].eqNullSafe(most._m))
    state = _cut(tied.select(conversation, "msg_id", F.col("_p").alias("up"), F.array(F.struct("ts", "msg_id")).alias("path"), "_most"), spark)
    while not state.filter("up is not null").isEmpty():
        upper = state.select(F.col(conversation).alias("_c"), F.col("msg_id").alias("_p"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        low = state.filter("up is not null")
        low = low.join(upper, (low[conversation] == upper._c) & (low.up == upper._p)).select(conversation, "msg_id", F.col("_up").alias("up"), F.concat("_path", "path").alias("path"), "_most")
        # a path of more messages than the conversation has is a cycle
        state = _cut(state.filter("up is null").unionByName(low.filter("size(path) <= _most")), spark)
    return state.select(conversation, "msg_id", (F.size("path") - 1).alias("depth"), "path")


def stitched(edges: DataFrame) -> DataFrame:
    """(id, component) of an undirected edge list (a, b): the smallest id reachable. Labels fall to the smallest neighbour's and to their label's label; each round is checkpointed in the shared folder where one is set, until none changes."""
    spark = edges.sparkSession
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    both = _cut(both, spark)
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")).select(F.col("a").alias("id"), "l")
    labels = _cut(labels, spark)
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("l").alias("m"))
        jump = labels.select(F.col("id").alias("_j"), F.col("l").alias("_jl"))
        new = labels.join(near, labels.id == near.a).select("id", F.least("l", "m").alias("n"), F.col("l").alias("o"))
        new = _cut(new.join(jump, new.n == jump._j, "left").select("id", F.least("n", "_jl").alias("l"), "o"), spark)
        labels = new.select("id", "l")
        if new.filter("l <> o").isEmpty():
            break
    return labels.withColumnRenamed("l", "component")


def _cut(df: DataFrame, spark) -> DataFrame:
    """Cut lineage by a table in the cluster's folder."""
    from ..sources.shared import kept

    return kept(df, "links")


def own_reply_chains(messages: DataFrame, author: Column, least: int = 3) -> DataFrame:
    """(head, length): chains of an author's replies to themselves, each from a head by them whose parent is missing or another's, following the first own reply. Steps double each round."""
    spark = messages.sparkSession
    mine = messages.filter(author).select("msg_id", "parent_id", "ts")
    pairs = mine.alias("c").join(mine.alias("p"), F.col("c.parent_id") == F.col("p.msg_id"))
    first = _cut(pairs.groupBy(F.col("p.msg_id").alias("up")).agg(F.min(F.struct("c.ts", "c.msg_id"))["msg_id"].alias("at")), spark)
    heads = mine.join(mine.select(F.col("msg_id").alias("_p")), mine.parent_id == F.col("_p"), "left_anti").select(F.col("msg_id").alias("head"))
    most = first.count()
    ups = first.select(F.col("up").alias("_u"))
    steps = _cut(first.join(ups, first["at"] == ups._u, "left").select("up", "at", F.lit(1).cast("long").alias("n"), F.col("_u").isNotNull().alias("more")), spark)
    while not steps.filter("more").isEmpty():
        on = steps.select(F.col("up").alias("_u"), F.col("at").alias("_at"), F.col("n").alias("_n"), F.col("more").alias("_more"))
        far = steps.filter("more").join(on, F.col("at") == F.col("_u")).select("up", F.col("_at").alias("at"), (F.col("n") + F.col("_n")).alias("n"), F.col("_more").alias("more"))
        # more steps than there are: a cycle, which no head leads to
        steps = _cut(steps.filter("not more").unionByName(far.filter(F.col("n") <= most)), spark)
    found = heads.join(steps, F.col("head") == F.col("up"), "left").groupBy("head").agg((F.coalesce(F.max("n"), F.lit(0)) + 1).cast("long").alias("length"))
    return found.filter(F.col("length") >= least)


def segments_by_similarity(rows: DataFrame, by: str, order: str, vector: str, least: float = 0.6) -> DataFrame:
    """rows with segment: a cosine to the row before under `least` starts a new one."""
    from ..functions.vectors import cosine

    w = Window.partitionBy(by).orderBy(order)
    new = F.lag(vector).over(w).isNull() | (cosine(F.col(vector), F.lag(vector).over(w)) < least)
    return _islands(rows.withColumn("_new", new), by, [order], F.col("_new"), "segment").drop("_new")


def batches(rows: Iterator, size: int) -> Iterator[list]:
    """Lists of at most size items, for calls to a model that takes several at once."""
    part: list = []
    for r in rows:
        part.append(r)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


def ancestor_heads(units: DataFrame, hops: int = 6, cap: int = 400) -> DataFrame:
    """(id, head): the texts of up to `hops` ancestors, the furthest first, joined by " > "; a head over cap characters loses a fifth at its end until it fits. units: (id, parent, text)."""
    up = units.select(F.col("id").alias("_id"), F.col("parent").alias("_parent"), F.col("text").alias("_text"))
    at = units.filter("parent is not null").select("id", F.col("parent").alias("_at"), F.array().cast("array<string>").alias("chain"))
    for _ in range(hops):
        on = at.join(up, F.col("_at") == F.col("_id"), "left")
        at = on.select("id", F.col("_parent").alias("_at"), F.when(F.col("_id").isNotNull(), F.concat(F.array("_text"), "chain")).otherwise(F.col("chain")).alias("chain"))
    head = F.array_join("chain", " > ")
    # a fifth off each time: so many times that any length comes down to the cap
    short = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.length("head"), lambda n, _: F.when(n > cap, F.floor(n * 8 / 10).cast("int")).otherwise(n))
    return at.filter(F.size("chain") > 0).select("id", head.alias("head")).select("id", F.substring("head", F.lit(1), short).alias("head"))
