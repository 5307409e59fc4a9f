"""Mixing sources to target weights by hash thresholds.

Every source gets a target size: its weighted share of the total, at most `most` times what it holds, the excess shared
again by weight until no source is above. A source whose target is above its size takes all its documents as often as
fits; the rest of its target is a sample of its documents whose hash is below the source's threshold. The threshold is
found with histograms: sizes summed by source and hash bucket, the bucket in which the running sum crosses the budget,
then finer buckets inside that bucket only. Nothing is sorted, and reruns take the same documents.

Results: a null text has size 0; sources come by code point, null last, as a source of its own; a source of size 0 has
target 0. Rows that repeat a doc_id share a hash and, within a source, are taken or left together; each row counts for its
own source. Rows without a doc_id have hashes of their own, from their text and their place in the table, so a table read
in the same parts gives the same mix. Extra columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, stored, unused

#: A hash has LEVELS groups of BITS bits; each level narrows the crossing bucket by 2 ** BITS.
BITS, LEVELS = 10, 4
#: A table of at most so many sources is broadcast.
SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3) -> DataFrame:
    """(source, source_size) -> with target. One row a source: the windows below order sources, not documents."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    # sources fill up in order of cap / weight; the level is what the rest gets once those before are full
    rows = rows.withColumn("k", F.row_number().over(fill)).withColumn(
        "level",
        (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    final = F.min_by("level", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("k"))).over(every)
    return rows.select("source", "source_size", F.least("cap", F.coalesce(final * F.col("weight"), F.col("cap"))).alias("target"))


def thresholds(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(s, source_size, target, times, below), stored, one row a source: all its documents are taken `times` times, and those whose hash is under `below` once more."""
    base = stored(docs.select(F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), _place(F.col(doc_id), F.col(text)).alias("h")), "sizes")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    state = targets(sizes, weights, share, most).withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    state = state.withColumn("left", F.col("target") - F.col("times") * F.col("source_size")).withColumn("below", F.lit(0).cast("long"))
    state = stored(state.withColumnRenamed("source", "s"), "targets")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = base.join(_small(state.select("s", "below")), base.source.eqNullSafe(F.col("s")))
        if level:  # only the bucket that the last level stopped in
            inside = inside.filter(F.shiftright("h", shift + BITS) == F.col("below"))
        buckets = inside.groupBy("s", F.shiftright("h", shift).alias("b")).agg(F.sum("size").cast("double").alias("sum"))
        upto = F.sum("sum").over(Window.partitionBy("s").orderBy("b"))
        crossed = buckets.withColumn("upto", upto).join(_small(state.select(F.col("s").alias("s2"), "left")), F.col("s").eqNullSafe(F.col("s2"))).filter(F.col("upto") > F.col("left"))
        first = crossed.groupBy("s").agg(F.min_by(F.struct("b", (F.col("left") - (F.col("upto") - F.col("sum"))).alias("left"), "sum"), "b").alias("x")).withColumnRenamed("s", "s3")
        on = state.join(first, state.s.eqNullSafe(F.col("s3")), "left")
        end = (F.col("below") + 1) * (1 << BITS) if level else F.lit(1 << BITS)  # no crossing: all of the bucket goes
        below = F.coalesce(F.col("x.b"), end.cast("long"))
        if level == LEVELS - 1:  # the last bucket is taken whole where that comes nearer
            below = F.when(F.col("x").isNotNull() & (2 * F.col("x.left") >= F.col("x.sum")), F.col("x.b") + 1).otherwise(below)
        state = stored(on.select("s", "source_size", "target", "times", F.coalesce(F.col("x.left"), F.lit(0.0)).alias("left"), below.alias("below")), "targets")
    discard(base)
    return state.select("s", "source_size", "target", F.when(F.col("times") < most, F.col("below")).otherwise(0).alias("below"), "times")


def _place(doc_id: Column, text: Column) -> Column:
    """The hash that thresholds are held against; to be taken where the table is read."""
    own = F.when(doc_id.isNull(), F.xxhash64(text, F.monotonically_increasing_id()))
    return F.shiftrightunsigned(F.xxhash64(F.lit("mix"), doc_id, own), 64 - BITS * LEVELS)


def _small(state: DataFrame) -> DataFrame:
    return F.broadcast(state) if state.count() <= SOURCES else state


def plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, times): how often the mix takes each document."""
    state = thresholds(docs, weights, share, most, doc_id, text, source)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), _place(F.col(doc_id), F.col(text)).alias("h"))
    extra = (F.col("h") < F.col("below")).cast("int")
    return rows.join(_small(state), F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "source_size", "target", (F.col("times") + extra).alias("times"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """docs with each row as often as the mix takes it. What decides is the row's hash and its source's threshold, so the texts stay where they are."""
    state = thresholds(docs, doc_id=doc_id, text=text, source=source, **options)
    s, below, times, h, n = (unused(docs, f"_mix_{x}") for x in ("s", "below", "times", "h", "n"))
    state = state.select(F.col("s").alias(s), F.col("below").alias(below), F.col("times").alias(times))
    placed = docs.withColumn(h, _place(F.col(doc_id), F.col(text)))
    joined = placed.join(_small(state), placed[source].cast("string").eqNullSafe(F.col(s)))
    taken = joined.withColumn(n, F.col(times) + (F.col(h) < F.col(below)).cast("int")).filter(F.col(n) > 0)
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(n))).alias(unused(docs, "_mix_k"))).select(*docs.columns)
