"""The archive's tables for people who ask in SQL: views, functions, and statements that only read."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .archive import event_messages, read

#: Functions for statements, in SQL itself, so that they stay inside Spark's expressions.
FUNCTIONS = {
    "local_day": "(seconds BIGINT) RETURNS STRING RETURN date_format(timestampadd(SECOND, seconds + 19800, TIMESTAMP_NTZ'1970-01-01 00:00:00'), 'yyyy-MM-dd')",
    "name_key": "(name STRING) RETURNS STRING RETURN trim(regexp_replace(lower(coalesce(name, '')), '[^a-z0-9]+', ' '))",
    "id_time": "(id BIGINT) RETURNS BIGINT RETURN CASE WHEN id > 10000000000000 THEN (shiftright(id, 22) + 1288834974657) div 1000 END",
}
#: Words that a statement that only reads has no use for, outside quotes.
CHANGING = ("insert", "update", "delete", "merge", "drop", "create", "alter", "truncate", "replace into", "set", "use", "cache", "uncache", "refresh", "load", "grant", "revoke", "analyze", "add", "reset", "declare", "execute", "call", "copy", "optimize", "transform", "reflect", "java_method")


def register(spark: SparkSession, sf_dir: str) -> None:
    """The views accounts, people, threads, messages and msg_stats, and the functions."""
    m = event_messages(spark, sf_dir)
    read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("platform"), F.col("c_nationkey").alias("person_id")).createOrReplaceTempView("accounts")
    read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("person_id"), F.col("n_name").alias("name")).createOrReplaceTempView("people")
    m.createOrReplaceTempView("messages")
    m.groupBy("thread_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).createOrReplaceTempView("threads")
    m.groupBy("author").agg(F.count("*").alias("n"), F.count_if("is_me").alias("mine")).createOrReplaceTempView("msg_stats")
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")


def refused(text: str) -> str | None:
    """Why a statement is not run; None for one that only reads. It has to be one SELECT, with what WITH defines before it if need be."""
    bare = re.sub(r"--[^\n]*|/\*.*?\*/", " ", re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`", "''", text), flags=re.S).strip()
    bare = bare.removesuffix(";").strip().lower()
    if ";" in bare:
        return "more than one statement"
    if not re.match(r"(select|with)\b", bare):
        return "not a SELECT"
    if found := re.search(r"\b(" + "|".join(CHANGING) + r")\b", bare):
        return f"not allowed: {found[1]}"
    return None


def only_reads(text: Column) -> Column:
    """refused() for a column of statements, true for those that only read: a log of what was asked is judged where it lies."""
    quoted = r"""'(?:[^'\\\\]|\\\\.|'')*'|"(?:[^"\\\\]|\\\\.)*"|`[^`]*`""".replace("\\\\", "\\")
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(quoted), F.lit("''")), F.lit(r"--[^\n]*|(?s:/\*.*?\*/)"), F.lit(" ")))
    bare = F.lower(F.regexp_replace(F.regexp_replace(bare, r"^\s+|\s+$", ""), r";\s*$", ""))
    return ~bare.contains(";") & bare.rlike(r"^(select|with)\b") & ~bare.rlike(r"\b(" + "|".join(CHANGING) + r")\b")


def select(spark: SparkSession, text: str, limit: int | None = None, deadline: float | None = None) -> DataFrame:
    """What a statement gives, run lazily. With a deadline (seconds) its jobs are cancelled once it is over; the rows, `limit` of them at most, are then fetched at once."""
    if why := refused(text):
        raise ValueError(why)
    if deadline is not None and limit is None:
        raise ValueError("a deadline needs a limit: its rows come to the driver")
    df = spark.sql(text.strip().removesuffix(";"))
    df = df if limit is None else df.limit(limit)
    if deadline is None:
        return df
    import threading
    import uuid

    tag = f"select-{uuid.uuid4().hex}"
    clock = threading.Timer(deadline, lambda: spark.sparkContext.cancelJobsWithTag(tag))
    spark.sparkContext.addJobTag(tag)
    clock.start()
    try:
        return spark.createDataFrame(df.collect(), df.schema)  # at most limit rows
    finally:
        clock.cancel()
        spark.sparkContext.removeJobTag(tag)
