"""Exact order statistics of groups of any size, by nested histograms instead of a sort of the group.

Values of a group are counted in buckets of equal width between its least and its greatest. The bucket in which the wanted rank
lies is known from the running counts; the next round counts inside it alone, between its own least and greatest values. What
a round shuffles are counts, at most BUCKETS a group, made before the shuffle. Once the bucket has SMALL rows or fewer, or but
one value, its rows are ranked. Rounds narrow the range by BUCKETS each time, so a few do; after ROUNDS what is left is ranked
as it is, which only values over hundreds of orders of magnitude need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept

BUCKETS, SMALL, ROUNDS = 1024, 10_000, 12
#: Rows of the state, one a group and rank, that are broadcast.
BROADCAST_ROWS = 100_000


def ranked_values(values: DataFrame, by: str, value: str, ranks: list[Column]) -> DataFrame:
    """(by, v0, v1, ...): for each group the values that stand at some ranks, counted from 0; ranks: columns over n, the number of the group's values. Null values don't count, a null group is one, nan comes last."""
    rows = values.filter(F.col(value).isNotNull()).select(F.col(by).alias("_g"), F.col(value).alias("_v"))
    x = F.col("_v").cast("double")
    # nan and the infinities have no width; they stand in buckets of their own at the ends
    finite = ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = rows.withColumn("_side", F.when(F.isnan(x), 2).when(x == float("inf"), 1).when(x == float("-inf"), -1).otherwise(0))
    sides = rows.groupBy("_g", "_side").agg(F.count("*").alias("_c"), F.min(F.when(finite, F.col("_v"))).alias("_low"), F.max(F.when(finite, F.col("_v"))).alias("_high"))
    sizes = kept(sides, "sides")
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("_g").orderBy("_side").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # four rows a group at most
    every = sizes.withColumn("_before", before).withColumn("n", F.sum("_c").over(Window.partitionBy("_g")))
    asked = every.select("_g", "_side", "_c", "_low", "_high", "_before", F.posexplode(F.array(*(r.cast("long") for r in ranks))).alias("_q", "_k"))
    state = kept(asked.filter((F.col("_k") >= F.col("_before")) & (F.col("_k") < F.col("_before") + F.col("_c"))).select("_g", "_side", "_q", (F.col("_k") - F.col("_before")).alias("_k"), "_c", "_low", "_high"), "state")
    for _ in range(ROUNDS):
        wide = (F.col("_c") > SMALL) & (F.col("_side") == 0) & (F.col("_low") < F.col("_high"))
        open_ = state.filter(wide)
        if open_.isEmpty():
            break
        inside = _inside(rows, open_)
        low, high = F.col("_low").cast("double"), F.col("_high").cast("double")
        # halves, as a difference of two large values may be beyond a double
        place = F.least(F.lit(BUCKETS - 1), F.floor((F.col("_v").cast("double") / 2 - low / 2) / (high / 2 - low / 2) * BUCKETS)).alias("_b")
        counts = inside.groupBy("_g", "_q", "_k", place).agg(F.count("*").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        w = Window.partitionBy("_g", "_q").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # BUCKETS rows at most
        counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))
        hit = counts.filter((F.col("_k") >= F.col("_before")) & (F.col("_k") < F.col("_before") + F.col("_c")))
        state = kept(state.filter(~wide).unionByName(hit.select("_g", F.lit(0).alias("_side"), "_q", (F.col("_k") - F.col("_before")).alias("_k"), "_c", "_low", "_high")), "state")
    sure = state.filter("_side <> 0 or _low = _high")
    last = state.filter("_side = 0 and _low < _high")
    place = F.row_number().over(Window.partitionBy("_g", "_q").orderBy("_v")) - 1
    found = _inside(rows, last).select("_g", "_q", "_k", "_v", place.alias("_at")).filter("_at = _k").select("_g", "_q", "_v")
    ends = F.when(F.col("_side") == 2, float("nan")).when(F.col("_side") == 1, float("inf")).when(F.col("_side") == -1, float("-inf"))
    kind = rows.schema["_v"].dataType
    both = found.unionByName(sure.select("_g", "_q", F.coalesce(ends.cast(kind) if kind.typeName() in ("double", "float") else F.lit(None).cast(kind), F.col("_low")).alias("_v")))
    return both.groupBy(F.col("_g").alias(by)).agg(*(F.max(F.when(F.col("_q") == k, F.col("_v"))).alias(f"v{k}") for k in range(len(ranks))))


def _inside(rows: DataFrame, state: DataFrame) -> DataFrame:
    """The finite rows between the bounds of their group's state, for each rank that is asked."""
    s = state.select(F.col("_g").alias("_h"), "_q", "_k", "_low", "_high")
    s = F.broadcast(s) if s.count() <= BROADCAST_ROWS else s
    on = F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high"))
    return rows.filter("_side = 0").join(s, on).drop("_h")


def nearest_rank(values: DataFrame, by: str, value: str, p: float) -> DataFrame:
    """(by, q): the value at floor(n * p), counted from 0 and at most n - 1."""
    return ranked_values(values, by, value, [F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(p)))]).withColumnRenamed("v0", "q")


def upper_median(values: DataFrame, by: str, value: str) -> DataFrame:
    """(by, median): the value at half the count."""
    return ranked_values(values, by, value, [F.expr("n div 2")]).withColumnRenamed("v0", "median")


def median(values: DataFrame, by: str, value: str) -> DataFrame:
    """(by, median): the mean of the two values in the middle, which are one where the count is odd."""
    both = ranked_values(values, by, value, [F.expr("(n - 1) div 2"), F.expr("n div 2")])
    return both.select(by, ((F.col("v0").cast("double") + F.col("v1").cast("double")) / 2).alias("median"))
