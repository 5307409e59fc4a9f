"""Document fingerprints: exact digests of a canonical text.

The canonical text is the text in Unicode form NFKC with full case folding, blanks of all kinds folded to single spaces,
the ends trimmed. Its fingerprint is 128 bits of xxhash64 (two salted passes, 32 hex digits). Texts and edited texts are
grouped by it, and inside each bucket of several the canonical bytes are compared; where they differ, every text of that
bucket gets the SHA-256 of its canonical text appended, so that equal fingerprints always mean equal canonical texts.

Texts are shuffled once, to meet the next document. For the comparison the table is read again: what is not in a bucket
of several falls out in the scan, and of the rest minimum and maximum are merged before they are shuffled, so a bucket with
a third of all rows is a row a task. Edited texts whose own text is canonically the same were compared on the way.

Normalisation and folding are those of the ICU library that Spark ships for its collations, called by SQL's reflect().

An exact digest knows equal and unequal only, so the likeness of two fingerprints is 1 or 0.

Results: null and empty texts share the fingerprint of the empty text. Copies share fingerprints. Rows that repeat a
doc_id are ordered by 128 bits of their text; null ids come first. A single document follows itself. Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import digest128, stored

#: Unicode's White_Space characters, and the zero-width ones that folding drops.
BLANKS = r"[\u0009-\u000D \u0085   -     　]+"
UNSEEN = r"[​-‍⁠﻿­]+"
#: Rows that one ordered bucket holds, about; ids at which ranges are cut, at most; equal parts of a range, at most.
BUCKET_ROWS, CUTS, PARTS = 4000, 128, 4096
#: Digests or documents of at most so many are broadcast (some 10 MB); more meet the texts by a shuffle.
BROADCAST_ROWS = 200_000


def _java(owner: str, method: str, text: Column, flag: bool) -> Column:
    return F.call_function("reflect", F.lit(owner), F.lit(method), text, F.lit(flag))


def canonical(text: Column) -> Column:
    """Plain ASCII needs no normalisation and only lower case; all else goes through NFKC, folding and NFKC again."""
    compose = lambda c: _java("com.ibm.icu.text.Normalizer", "compose", c, True)
    folded = compose(_java("com.ibm.icu.lang.UCharacter", "foldCase", compose(text), True))
    plain = F.octet_length(text) == F.length(text)
    return F.trim(F.regexp_replace(F.regexp_replace(F.when(plain, F.lower(text)).otherwise(folded), UNSEEN, ""), BLANKS, " "))


def next_rows(rows: DataFrame, carried: list[str]) -> DataFrame:
    """rows of (doc_id, tie, ...) with next_<c> of the following row, by doc_id and tie, for each column carried; after the last row comes the first.

    Rows go to ordered buckets: ranges cut at quantiles of the ids, and equal parts of those. A bucket's first row also
    goes, as a guest, to the bucket that has rows before it, so every row finds its next one in its own bucket. The table
    of first rows has one small row a bucket and is broadcast."""
    total = rows.count()
    if not total:
        return rows.select("*", *(F.col(c).alias(f"next_{c}") for c in carried))
    many = max(1, -(-total // BUCKET_ROWS))
    ranges = min(CUTS, many)
    points = rows.select(F.percentile_approx("doc_id", [k / ranges for k in range(ranges + 1)], 10 * CUTS)).first()[0] or [0]
    cuts = sorted(set(points))
    parts = min(PARTS, -(-many // ranges))
    bucket = F.lit(0).cast("long")
    for k, (low, high) in enumerate(zip(cuts, [*cuts[1:], cuts[-1] + 1])):
        inner = F.floor((F.col("doc_id").cast("double") - low) / float(high - low) * parts)
        bucket = F.when(F.col("doc_id") >= low, F.lit(k * (parts + 1) + 1) + F.least(F.lit(parts), inner)).otherwise(bucket)
    # rows without an id, which may be many, are told apart by the first two hex digits of their tie
    nameless = F.coalesce(F.conv(F.substring("tie", 1, 2), 16, 10).cast("long"), F.lit(0)) - 256
    keyed = rows.withColumn("b", F.when(F.col("doc_id").isNull(), nameless).otherwise(bucket))
    first = keyed.groupBy("b").agg(F.min(F.struct(F.col("doc_id"), F.col("tie"))).alias("first"))
    # one row a bucket: (first row of the bucket, the bucket with rows before it; before the first bucket the last)
    order = Window.orderBy("b")
    before = F.coalesce(F.lag("b").over(order), F.max("b").over(Window.partitionBy()))
    heads = stored(first.select("b", "first", before.alias("before"), F.row_number().over(order).alias("k")), "heads")
    found = keyed.join(F.broadcast(heads.withColumnRenamed("b", "hb")), F.col("b") == F.col("hb"))
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tie") == F.col("first.tie"))
    homes = F.array_compact(F.array(F.struct(F.col("b").alias("b"), F.lit(0).alias("guest")), F.when(is_first, F.struct(F.col("before").alias("b"), F.when(F.col("k") == 1, 2).otherwise(1).alias("guest")))))
    dealt = found.withColumn("home", F.explode(homes)).select(*rows.columns, F.col("home.b").alias("b"), F.col("home.guest").alias("guest"))
    # rows of a bucket stand before its guests, so only the last row meets one
    w = Window.partitionBy("b").orderBy("guest", F.col("doc_id").asc_nulls_first(), "tie")
    return dealt.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in carried)).filter("guest = 0").drop("b", "guest")


def _edited(n: Column) -> Column:
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter))


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("tie", digest128(F.col("text")))
    own = rows.withColumn("c", canonical(F.col("text"))).select("doc_id", "tie", "text", digest128(F.col("c")).alias("f"), _sha(F.col("c")).alias("s"))
    table = next_rows(own, ["doc_id", "tie", "text", "f", "s"]).withColumn("edited", _edited(F.length("text"))).withColumn("ce", canonical(F.col("edited"))).withColumn("fe", digest128(F.col("ce")))
    same = F.when(F.col("f") == F.col("fe"), canonical(F.col("text")) == F.col("ce")).otherwise(False)
    kept = ["doc_id", "tie", "next_doc_id", "next_tie", "f", "s", "next_f", "next_s"]
    half = table.select(*kept, F.length("text").cast("long").alias("n_chars"), _sha(F.col("edited")).alias("edited_sha256"), "fe", _sha(F.col("ce")).alias("se"), same.alias("same"))
    half = stored(half, "fingerprints")
    clash = colliding(rows, half)
    named = half.select("*", F.col("f").alias("fingerprint"), F.col("fe").alias("edited_fingerprint"))
    if clash is not None:
        marked = half.join(clash.withColumnRenamed("bucket", "c1"), F.col("f") == F.col("c1"), "left").join(clash.withColumnRenamed("bucket", "c2"), F.col("fe") == F.col("c2"), "left")
        named = marked.select(*half.columns, F.when(F.col("c1").isNull(), F.col("f")).otherwise(F.concat_ws("-", "f", "s")).alias("fingerprint"), F.when(F.col("c2").isNull(), F.col("fe")).otherwise(F.concat_ws("-", "fe", "se")).alias("edited_fingerprint"))
    # in a bucket of one canonical text all s are the same; in the others s tells fingerprints apart
    alike = lambda a, b: F.when((F.col(f"{a[0]}") == F.col(b[0])) & (F.col(a[1]) == F.col(b[1])), 1.0).otherwise(0.0)
    return named.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", alike(("f", "s"), ("fe", "se")).alias("near_edited"), alike(("f", "s"), ("next_f", "next_s")).alias("near_next"))


def _some(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def colliding(rows: DataFrame, half: DataFrame) -> DataFrame | None:
    """(bucket) of fingerprints that different canonical texts share, None if there are none. rows: (doc_id, tie, text)."""
    entries = F.array_compact(F.array(F.col("f"), F.when(~F.col("same"), F.col("fe"))))
    several = stored(half.select(F.explode(entries).alias("f")).groupBy("f").agg(F.count("*").alias("n")).filter("n > 1").select("f"), "several")
    if several.isEmpty():
        return None
    wanted = _some(several)
    texts = rows.select(canonical(F.col("text")).alias("c")).withColumn("f", digest128(F.col("c"))).join(wanted, "f", "left_semi")
    # edited texts of such buckets are few: their two texts are found again by id and digest
    edits = stored(half.filter("not same").join(wanted, half.fe == several.f, "left_semi").select("doc_id", "tie", "next_doc_id", "next_tie").distinct(), "edits")
    ends = edits.select(F.explode(F.array(F.struct("doc_id", "tie"), F.struct(F.col("next_doc_id").alias("doc_id"), F.col("next_tie").alias("tie")))).alias("x")).select("x.*").distinct().toDF("_id", "_tie")
    there = rows.join(_some(ends), rows.doc_id.eqNullSafe(F.col("_id")) & (rows.tie == F.col("_tie")), "left_semi").dropDuplicates(["doc_id", "tie"])
    a, b = there.toDF("i1", "text", "t1"), there.toDF("i2", "next_text", "t2")
    met = edits.join(a, F.col("doc_id").eqNullSafe(F.col("i1")) & (F.col("tie") == F.col("t1"))).join(b, F.col("next_doc_id").eqNullSafe(F.col("i2")) & (F.col("next_tie") == F.col("t2")))
    edited = met.select(canonical(_edited(F.length("text"))).alias("c")).withColumn("f", digest128(F.col("c")))
    every = texts.select("f", "c").unionByName(edited.select("f", "c"))
    differ = stored(every.groupBy("f").agg((F.min("c") != F.max("c")).alias("differ")).filter("differ").select(F.col("f").alias("bucket")), "collisions")
    return None if differ.isEmpty() else differ
