"""Writes: inserts, upserts, keys and quarantine as set operations between an old and a new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MISSING = "[Context Missing"


def inserted_if_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The rows of new whose key old lacks, one a key."""
    return new.dropDuplicates(key).join(old.select(*key), key, "left_anti")


def upgraded(old: DataFrame, new: DataFrame, key: str = "msg_id") -> DataFrame:
    """old with placeholders replaced by real content, and missing parents filled; rows only in new are added."""
    n = new.select(key, *(F.col(c).alias(f"_{c}") for c in new.columns if c != key))
    both = old.join(n, key, "full")
    was_gap = F.col("content").isNull() | F.col("content").startswith(MISSING)
    real = F.col("_content").isNotNull() & ~F.col("_content").startswith(MISSING)
    cols = []
    for c in old.columns:
        if c == key:
            cols.append(F.col(c))
        elif c == "content":
            cols.append(F.when(was_gap & real, F.col("_content")).otherwise(F.coalesce("content", "_content")).alias(c))
        else:
            cols.append(F.coalesce(c, f"_{c}").alias(c))
    return both.select(*cols)


def with_keys(known: DataFrame, rows: DataFrame, natural: list[str], key: str = "id") -> DataFrame:
    """known and the new natural keys of rows, numbered on from the largest key in order of the natural key."""
    fresh = rows.select(*natural).distinct().join(known.select(*natural), natural, "left_anti")
    top = known.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    n = ordered(fresh, natural, "_k").crossJoin(F.broadcast(top))  # one row
    return known.select(key, *natural).unionByName(n.select((F.col("_k") + 1 + F.col("_top")).alias(key), *natural))


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new in place of those with their key; of several new ones the last in order."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*key, "_v")]
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), "_v").alias("_r")).select(*key, "_r.*")


def changed(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after) where the value differs, null-safe."""
    n = new.select(key, F.col(value).alias("after"))
    return old.select(key, F.col(value).alias("before")).join(n, key).filter(~F.col("before").eqNullSafe(F.col("after")))


def purged(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    return rows.filter(~F.coalesce(F.col(key).startswith(prefix), F.lit(False)))


def quarantined(rows: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, moved); null counts as not bad."""
    b = F.coalesce(bad, F.lit(False))
    return rows.filter(~b), rows.filter(b)


def free_ids(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with key made unique: the k-th repeat gets ~k appended."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_k", k).withColumn(key, F.when(F.col("_k") > 1, F.concat(F.col(key).cast("string"), F.lit("~"), F.col("_k").cast("string"))).otherwise(F.col(key).cast("string"))).drop("_k")


def append_new(stored: DataFrame, export: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The rows of an export not stored yet, as multisets: with n equal rows stored, the first n of the export are taken to be those. Nothing stored is ever dropped."""
    have = stored.groupBy(*(F.col(c).alias(f"_h_{c}") for c in key)).agg(F.count("*").alias("_have"))
    k = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    cond = [F.col(c).eqNullSafe(F.col(f"_h_{c}")) for c in key]
    return export.withColumn("_k", k).join(have, cond, "left").filter(F.col("_k") > F.coalesce("_have", F.lit(0))).select(*export.columns)


def merged_vectors(ids: DataFrame, fresh: DataFrame, old: DataFrame, key: str, vector: str) -> DataFrame:
    """The vector of each id: a fresh one, else the old one; fails if one has neither."""
    f, o = fresh.select(key, F.col(vector).alias("_f")), old.select(key, F.col(vector).alias("_o"))
    both = ids.select(key).join(f, key, "left").join(o, key, "left").withColumn(vector, F.coalesce("_f", "_o"))
    return both.select(key, F.when(F.col(vector).isNull(), F.raise_error(F.concat(F.lit("no vector for "), F.col(key).cast("string"))).cast(both.schema[vector].dataType)).otherwise(F.col(vector)).alias(vector))


def write_quoted(df: DataFrame, path: str) -> None:
    """CSV with a header, every field quoted, quotes doubled."""
    df.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def export_missing(rows: DataFrame, vectors: DataFrame, key: str, path: str) -> None:
    """Rows that have no vector, as compressed JSON lines for a batch job elsewhere."""
    rows.join(vectors.select(key), key, "left_anti").write.option("compression", "gzip").json(path)


def recreated(df: DataFrame, name: str) -> DataFrame:
    """A derived table dropped and made anew under its name."""
    df.write.mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def cached(scope: DataFrame, memo: DataFrame, stamp: DataFrame, compute, key: str) -> DataFrame:
    """(key, stamp, result): results held for the present stamp of their scope, the others computed now. memo: (key, stamp, result), stamp: (key, stamp); compute takes the keys that need it and gives (key, result)."""
    now = scope.select(key).join(stamp, key)
    held = now.join(memo, [key, "stamp"])
    rest = now.join(held.select(key), key, "left_anti")
    return held.select(key, "stamp", "result").unionByName(rest.join(compute(rest.select(key)), key).select(key, "stamp", "result"))


def compacted(comments: DataFrame, key: str, order: str, body: list[str]) -> DataFrame:
    """The first copy of each comment; fails where copies of one differ. Replies name their parent by its id, so those found under a later copy belong to the one that is kept."""
    same = F.struct(*body)
    each = comments.groupBy(key).agg(F.min_by(F.struct(*(c for c in comments.columns if c != key)), order).alias("_r"), (F.min(same) != F.max(same)).alias("_differ"))
    checked = F.when(F.col("_differ"), F.raise_error(F.concat(F.lit("copies differ: "), F.col(key).cast("string"))).cast(each.schema["_r"].dataType)).otherwise(F.col("_r"))
    return each.select(key, checked.alias("_r")).select(key, "_r.*")


def report(spark, lines: list[tuple[str, int]]) -> str:
    """A run's report in Markdown, from counts that the run has made."""
    return "\n".join(["# Run", *(f"- {what}: {n:,}" for what, n in lines)])


def stale(counts: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Keys whose stored count is not the present one, those without a stored one too. Both: (key, n)."""
    h = held.select(key, F.col("n").alias("_n"))
    return counts.join(h, key, "left").filter(~F.col("n").eqNullSafe(F.col("_n"))).select(key)


def pending(rows: DataFrame, done: DataFrame, key: str, version: str) -> DataFrame:
    """Rows not yet done in this version. done: (key, version)."""
    return rows.join(done.filter(F.col("version") == version).select(key), key, "left_anti")


def reimported(stored: DataFrame, export: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """stored and what an export adds to it: nothing stored goes, and what stands in both as often is not added again."""
    return stored.unionByName(append_new(stored, export, key, order))


def ordered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with their place in an order, from 0. Ranges are numbered each by itself and shifted by what stands before them, so no task has to see all rows; rows that the order holds equal share a range. The ranges are written, so that both passes see the same ones."""
    from ..sources.shared import kept

    dealt = kept(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))  # a row a range
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn(name, place).join(F.broadcast(starts), "_range").withColumn(name, (F.col(name) + F.col("_start")).cast("long")).drop("_range", "_start")


def met_under(left: DataFrame, right: DataFrame, on: list[str], chunk: int = 2000) -> DataFrame:
    """Pairs of rows that agree in the columns `on`: left's other columns with l_ before, right's with r_. Keys of more than `chunk` rows of right are dealt into chunks, and left's rows go to each, so that the pairs of one key are many tasks; pairs themselves are not shuffled. They leave in order of the key, as both sides are sorted by it: rows of left that meet the same rows of right follow each other, which files of the pairs need to be small."""
    named = lambda df, side: df.select(*on, *(F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in on))
    l, r = named(left, "l"), named(right, "r")
    crowded = r.groupBy(*on).agg(F.ceil(F.count("*") / chunk).cast("int").alias("_chunks")).filter("_chunks > 1")
    chunks = F.coalesce("_chunks", F.lit(1))
    dealt = r.join(crowded, on, "left").withColumn("_chunk", F.pmod(F.xxhash64(*r.columns), chunks).cast("int")).drop("_chunks")
    asks = l.join(crowded, on, "left").withColumn("_chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).drop("_chunks")
    # a fixed number of parts, as few bytes may make many pairs and would be put together into a few tasks
    spark = left.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return asks.repartition(parts, *on, "_chunk").hint("merge").join(dealt.repartition(parts, *on, "_chunk"), [*on, "_chunk"]).drop("_chunk")
