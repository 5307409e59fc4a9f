"""Balanced label propagation: linked documents gather in a shard, and shards stay even.

Links are memberships (document, group), which stand for all edges inside a group; documents with equal texts are linked.
What the rounds work on is how many members of a group are in which shard, one small row for each such pair, so a group
with a third of all rows is sixteen rows.

1. Groups that a shard's quota or a task should not meet as one (larger than a quarter of the quota, or than LARGE rows)
   are placed first, the largest first: each fills the shards with most room one by one. They are few, by their size.
2. Members of the other groups start in shards by hash, in proportion to the room left. In each round a group votes for
   the shard that most of its members are in, and members elsewhere ask to move there. How many may move from shard i to
   shard j is a quota: as many as ask to move back, and what free room j has besides. Moves are let in by hash, whole
   groups at a time. When that leads no further, groups still split vote for a shard with places for all of them. Rounds
   end when the number of cut edges falls no more.
3. Documents without links fill the free places. At the end positions in the order (shard, group block, group, document)
   are cut into equal runs, so that counts differ by one at most and only groups at a cut are split.

Results: a null text counts as an empty one. Rows that repeat a doc_id are all placed. Order inside a shard is fixed by
the hashes, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import digest128, discard, stored

#: Rows from which a group is placed by itself, and rows that one ordered block holds, about.
LARGE, BLOCK_ROWS = 10_000, 2_000
#: Blocks of a shard, at most, and hash buckets by which moves are let in.
BLOCKS, LETS = 4096, 1024


def _unit(*columns) -> Column:
    """A hash as a number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def _by_share(unit: Column, shares: list[float]) -> Column:
    """The number of the share in which unit falls."""
    total, upto, ends = sum(shares), 0.0, []
    for k, x in enumerate(shares):
        upto += x
        if x > 0:
            ends.append((upto / total, k))
    at = F.lit(ends[-1][1])
    for end, k in reversed(ends[:-1]):
        at = F.when(unit < end, k).otherwise(at)
    return at.cast("int")


def _place_large(large: list[tuple[str, int]], shards: int, quota: float) -> tuple[dict[str, list[float]], list[float]]:
    """(rows of each large group by shard, room left by shard)"""
    room, placed = [quota] * shards, {}
    for g, n in large:
        placed[g], left = [0.0] * shards, float(n)
        for k in sorted(range(shards), key=lambda k: (-room[k], k)):
            part = min(left, room[k])
            placed[g][k] += part
            room[k] -= part
            left -= part
        if left > 0:  # rounding
            placed[g][0] += left
    return placed, room


def cut_edges(held: DataFrame) -> int:
    """Pairs of members of one group in different shards. held: (g, shard, n)."""
    by = held.groupBy("g").agg(F.sum("n").alias("m"), F.sum(F.col("n").cast("decimal(38,0)") * F.col("n")).alias("inside"))
    return int(by.agg(F.sum((F.col("m").cast("decimal(38,0)") * F.col("m") - F.col("inside")) / 2)).first()[0] or 0)


def _swaps(asked: dict[tuple[int, int], int], room: list[float]) -> dict[tuple[int, int], float]:
    """How many may move from each shard to each other one: swaps, and what fits into the free room."""
    free, quota = list(room), {}
    for (i, j), n in asked.items():
        quota[i, j] = float(min(n, asked.get((j, i), 0)))
    for (i, j), n in sorted(asked.items(), key=lambda x: -x[1]):
        more = max(0.0, min(n - quota[i, j], free[j]))
        quota[i, j] += more
        free[j] -= more
        free[i] += more
    return quota


def _wanted(held: DataFrame, free: list[float], seed: int, settle: bool) -> DataFrame:
    """(g, want): the shard that most members of a group are in; to settle, of those groups still split, the one of the shards with places for the rest of it."""
    tie = F.xxhash64(F.lit(seed), "g", "shard")
    if not settle:
        return held.groupBy("g").agg(F.max_by("shard", F.struct("n", tie)).alias("want"))
    places = held.sparkSession.createDataFrame([(k, float(x)) for k, x in enumerate(free)], "shard int, free double")
    split = held.groupBy("g").agg(F.sum("n").alias("m"), F.count("*").alias("parts")).filter("parts > 1")
    rows = split.join(F.broadcast(places.filter("free > 0"))).join(held, ["g", "shard"], "left").withColumn("n", F.coalesce("n", F.lit(0)))  # each group with the few shards
    return rows.filter("free >= m - n").groupBy("g").agg(F.max_by("shard", F.struct("n", tie)).alias("want"))


def _round(held: DataFrame, room: list[float], seed: int, settle: bool) -> DataFrame | None:
    """held after the moves of one round, None if none is let in. room: places by shard."""
    spark = held.sparkSession
    loads = {r["shard"]: r["n"] for r in held.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    free = [r - loads.get(k, 0) for k, r in enumerate(room)]
    want = _wanted(held, free, seed, settle)
    asking = held.join(want, "g", "left").withColumn("want", F.coalesce("want", "shard")).withColumn("b", F.floor(_unit(F.lit(f"let{seed}"), "g") * LETS).cast("int"))
    asking = stored(asking, "asking")
    asked = stored(asking.filter("shard <> want").groupBy("shard", "want", "b").agg(F.sum("n").alias("n")), "asked")
    pairs = {(r["shard"], r["want"]): r["n"] for r in asked.groupBy("shard", "want").agg(F.sum("n").alias("n")).collect()}  # a number for each two shards
    quota = _swaps(pairs, free)
    limits = spark.createDataFrame([(i, j, q) for (i, j), q in quota.items()] or [(-1, -1, 0.0)], "shard int, want int, quota double")
    upto = F.sum("n").over(Window.partitionBy("shard", "want").orderBy("b"))
    let = asked.withColumn("upto", upto).join(F.broadcast(limits), ["shard", "want"]).filter("upto <= quota").select("shard", "want", "b", F.lit(True).alias("goes"))
    let = stored(let, "let")  # at most LETS rows for each two shards
    if let.isEmpty():
        discard(asking, asked, let)
        return None
    moved = asking.join(F.broadcast(let), ["shard", "want", "b"], "left").select("g", F.when(F.col("goes"), F.col("want")).otherwise(F.col("shard")).alias("shard"), "n")
    out = stored(moved.groupBy("g", "shard").agg(F.sum("n").alias("n")), "held")
    discard(asking, asked, let)
    return out


def propagated(held: DataFrame, room: list[float]) -> DataFrame:
    """held after rounds until the cut edges fall no more; they are whole numbers, so that ends. Where votes for the shard of most members lead nowhere, groups still split vote for one with places."""
    cut, seed, idle = cut_edges(held), 0, 0
    while cut and idle < 2:
        after = _round(held, room, seed, settle=idle == 1)
        seed += 1
        less = cut_edges(after) if after is not None else cut
        if less < cut:
            discard(held)
            held, cut, idle = after, less, 0
        else:
            idle += 1
            if after is not None:
                discard(after)
    return held


def shard(docs: DataFrame, shards: int = 16, slack: float = 1.05, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, group_id, shard, slot) of each row, counts at most one apart. slack: how much of an even share linked documents may take of a shard while they move; the cut at the end evens it out."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), digest128(body).alias("g"))
    base = stored(base, "documents")
    total = base.count()
    if not total:
        return base.select("doc_id", "size", "text_crc32", F.col("g").alias("group_id"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    quota = total / shards * slack
    groups = stored(base.groupBy("g").agg(F.count("*").alias("m")).filter("m > 1"), "groups")
    # at most 4 * shards and total / LARGE of them; on larger tables LARGE grows along
    limit = max(1.0, min(quota / 4, max(LARGE, total / LARGE)))
    large = sorted(((r["g"], r["m"]) for r in groups.filter(F.col("m") > limit).collect()), key=lambda x: (-x[1], x[0]))
    placed_large, room = _place_large(large, shards, quota)
    linked = groups.filter(F.col("m") <= limit)
    # members are numbered within their group, by hash thresholds of the shares: which document is which does not matter yet
    start = linked.select("g", F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("i")).select("g", _by_share(_unit("g", "i"), [max(r, 1e-6) for r in room]).alias("shard"))
    held = propagated(stored(start.groupBy("g", "shard").agg(F.count("*").alias("n")), "held"), room)
    taken = {r["shard"]: r["n"] for r in held.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    free = [max(0.0, r / slack - taken.get(k, 0)) for k, r in enumerate(room)]
    alone = _by_share(_unit(F.lit("free"), "doc_id", "g"), free if sum(free) > 0 else [1.0] * shards)
    # a document's shard: of large groups and lone documents by its hash, of the others by its number in the group
    spark = docs.sparkSession
    shares = spark.createDataFrame([(g, [float(x) for x in placed_large[g]]) for g, _ in large] or [("", [0.0])], "lg string, shares array<double>")
    marked = base.join(F.broadcast(shares), base.g == shares.lg, "left")
    upto = F.aggregate(F.col("shares"), F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("k"), F.lit(-1).alias("found")), lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), (acc["k"] + 1).alias("k"), F.when((acc["found"] < 0) & (x > 0) & (F.col("_u") * F.col("_all") < acc["sum"] + x), acc["k"]).otherwise(acc["found"]).alias("found")), lambda acc: acc["found"])
    marked = marked.withColumn("_u", _unit(F.lit("large"), "doc_id")).withColumn("_all", F.aggregate("shares", F.lit(0.0), lambda a, x: a + x))
    in_large = F.when(F.col("lg").isNotNull(), F.greatest(upto, F.lit(0)))
    marked = marked.withColumn("in_large", in_large).select(*base.columns, "in_large", "_all")
    block_rows = max(BLOCK_ROWS, total // 100_000)  # so that all blocks are some 200,000 at most
    hot = marked.filter("in_large is not null").withColumn("shard", F.col("in_large").cast("int")).withColumn("sub", (F.floor(_unit(F.lit("sub"), "doc_id", "size") * (F.floor(F.col("_all") / block_rows) + 1)) + 1).cast("int"))
    rest = marked.filter("in_large is null").join(linked, "g", "left")
    lone = rest.filter("m is null").withColumn("shard", alone)
    spans = held.select(F.col("g").alias("hg"), "shard", "n", (F.sum("n").over(Window.partitionBy("g").orderBy("shard")) - F.col("n")).alias("low"))
    members = rest.filter("m is not null").withColumn("i", F.row_number().over(Window.partitionBy("g").orderBy("doc_id")) - 1)
    members = members.join(spans, (members.g == spans.hg) & (F.col("i") >= F.col("low")) & (F.col("i") < F.col("low") + F.col("n")))
    columns = ["doc_id", "size", "text_crc32", "g", "shard"]
    placed = hot.select(*columns, F.col("g").alias("own"), "sub").unionByName(members.unionByName(lone, allowMissingColumns=True).select(*columns, F.lit("").alias("own"), F.lit(0).alias("sub")))
    blocks = max(1, min(BLOCKS, total // shards // block_rows))
    placed = stored(placed.withColumn("gb", F.pmod(F.xxhash64("g"), F.lit(blocks)).cast("int")), "placed")
    cell = ["shard", "gb", "own", "sub"]
    cells = placed.groupBy(*cell).agg(F.count("*").alias("n"))
    # one row a block: some thousands, and as many for each part of a large group
    starts = cells.select(*cell, (F.sum("n").over(Window.orderBy(*cell)) - F.col("n")).alias("start"))
    place = F.row_number().over(Window.partitionBy(*cell).orderBy("g", "doc_id")) - 1
    at = (F.col("start") + F.col("place")).cast("decimal(38,0)")
    final = F.floor(at * shards / F.lit(total)).cast("int")
    first = F.ceil(final.cast("decimal(38,0)") * F.lit(total) / shards)
    return placed.withColumn("place", place).join(F.broadcast(starts), cell).select("doc_id", "size", "text_crc32", F.col("g").alias("group_id"), final.alias("shard"), (at - first).cast("long").alias("slot"))
