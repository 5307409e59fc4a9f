"""The archive's tables, read from Parquet, and the message logs built on them.

Two logs stand for exported archives: `event_messages` (one thread a user, the event type as author) and
`chat_messages` (one thread a conversation, the role as author, times derived from conversation and turn).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times

#: The event type that stands for the archive's owner.
OWNER = "purchase"


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """msg_id, thread_id, author, ts, parent_id, value, is_me."""
    e = read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    parent = F.when(F.col("event_id") > 0, F.floor(F.col("event_id") / 3).cast("long"))
    return e.select(F.col("event_id").alias("msg_id"), F.col("user_id").alias("thread_id"), F.col("event_type").alias("author"), times.epoch(F.col("ts")).alias("ts"), parent.alias("parent_id"), "value", (F.col("event_type") == OWNER).alias("is_me"))


#: The same in SQL, to stand in WITH.
EVENTS_SQL = """msgs AS (SELECT event_id AS msg_id, user_id AS thread_id, event_type AS author, CAST(floor(epoch(ts)) AS BIGINT) AS ts,
  CASE WHEN event_id > 0 THEN event_id // 3 END AS parent_id, value, event_type = 'purchase' AS is_me FROM events)"""


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """msg_id, thread_id, turn, author, ts, content, parent_id."""
    c = read(spark, sf_dir, "conversations")
    turn = F.col("turn")
    ts = F.col("conv_id") * 86400 + turn * 61 + (F.col("conv_id") * 7919 + turn * 104729) % 5400
    parent = F.when(turn > 0, F.col("conv_id") * 1000 + F.when(turn % 3 != 0, turn - 1).otherwise(F.floor(turn / 2)))
    return c.select((F.col("conv_id") * 1000 + turn).alias("msg_id"), F.col("conv_id").alias("thread_id"), "turn", F.col("role").alias("author"), ts.alias("ts"), F.col("text").alias("content"), parent.alias("parent_id"))


CHATS_SQL = """chats AS (SELECT conv_id * 1000 + turn AS msg_id, conv_id AS thread_id, turn, role AS author,
  conv_id * 86400 + turn * 61 + (conv_id * 7919 + turn * 104729) % 5400 AS ts, text AS content,
  CASE WHEN turn > 0 THEN conv_id * 1000 + CASE WHEN turn % 3 <> 0 THEN turn - 1 ELSE turn // 2 END END AS parent_id FROM conversations)"""


def generated(threads: DataFrame) -> DataFrame:
    """(thread, msg_id, author, ts, content): a made-up archive of storylines and filler chats, by rules on the numbers, so the same every time. threads: (thread, k, story)."""
    t = threads.withColumn("n", 20 + (F.col("k") * 37) % 23)
    m = t.select("thread", "k", "n", "story", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    author = F.concat(F.lit("a"), (F.col("i") % (1 + (F.col("n") - 1) % 3)).cast("string"))
    content = F.when(F.col("story"), F.concat(F.lit("part "), F.col("i").cast("string"), F.lit(" of the plan"))).otherwise(F.concat(F.lit("hello "), (F.col("i") * 7 % 5).cast("string")))
    return m.select("thread", (F.col("k") * 1000 + F.col("i")).alias("msg_id"), author.alias("author"), (1_700_000_000 + F.col("k") * 86_400 + F.col("i") * 97).alias("ts"), content.alias("content"))
