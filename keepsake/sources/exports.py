"""Readers of message exports: one function a format, each from files under a path to rows.

All of them are Spark readers with expressions after them. JSON comes with the schema it is read by, so a field that an
export lacks is null. A file that isn't line-wise is one row of its reader and can't be split; exports of that kind come
in many part files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# What the files of each kind of export are called.
KINDS = (("twitter", r"^twitter.*\.zip$"), ("instagram", r"^instagram.*\.zip$"), ("facebook", r"^facebook.*\.zip$"), ("reddit", r".*reddit.*|^messages\.csv$|^comments\.csv$"), ("discord", r".*discord.*|^package\.zip$"), ("whatsapp", r".*(whatsapp|chatstorage).*|^msgstore.*"), ("contacts", r".*\.vcf$"))
CHAT = "participants array<struct<name:string>>, title string, thread_path string, messages array<struct<sender_name:string,timestamp_ms:long,content:string>>"
COMMENT = "timestamp long, title string, string_map_data struct<Comment:struct<value:string>,Time:struct<timestamp:long>>, data array<struct<comment:struct<timestamp:long,comment:string,author:string>>>"
POST = "array<struct<tweet:struct<id_str:string,full_text:string,created_at:string,in_reply_to_status_id_str:string,quoted_status_id_str:string>>>"
DIRECT = "array<struct<dmConversation:struct<conversationId:string,messages:array<struct<messageCreate:struct<id:string,senderId:string,text:string,createdAt:string>>>>>>"
NODE = "id:string,author:string,body:string,created_utc:bigint,replies:array<{}>"
CHANNEL = "channel struct<id:string,name:string>, messages array<struct<id:string,timestamp:string,content:string,author:struct<id:string,name:string>,attachments:array<struct<url:string>>,embeds:array<struct<title:string,description:string>>,reference:struct<messageId:string>>>"


def kind_of(path: Column) -> Column:
    """Which export a file is, by its name; null for none that is known."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS):
        out = F.when(name.rlike(pattern), kind).otherwise(out)
    return out


def zip_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): the zip archives at any depth under path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(path).select("path", "content")


def zip_members(archives: DataFrame, pattern: str) -> DataFrame:
    """(archive, member, content): the members of archives (path, content) whose name matches. An archive is opened in a task; its members leave one by one."""

    def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import re
        import zipfile

        wanted = re.compile(pattern)
        for part in parts:
            for name, raw in zip(part["path"], part["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for member in sorted(z.namelist()):
                        if wanted.search(member):
                            yield pd.DataFrame({"archive": [name], "member": [member], "content": [z.read(member)]})

    return archives.mapInPandas(unpack, "archive string, member string, content binary")


def part_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, value): whole text files of one kind, at any depth."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), "value")


def unwrapped(value: Column) -> Column:
    """JSON without what a script puts before its first bracket."""
    return F.substring(value, F.greatest(F.instr(value, "["), F.lit(1)), F.length(value))


def chats(files: DataFrame) -> DataFrame:
    """(thread, title, sender, ts, content, place, previous) from the chat files' text (value): messages of a thread in order of time, each with the place of the one before. Mojibake is repaired, milliseconds are floored."""
    f = files.select(F.from_json("value", CHAT).alias("c")).select("c.*")
    m = f.select(F.col("thread_path").alias("thread"), tx.repaired(F.col("title")).alias("title"), F.posexplode("messages").alias("k", "m"))
    w = Window.partitionBy("thread").orderBy("_ms", "k")
    rows = m.select("thread", "title", "k", tx.repaired(F.col("m.sender_name")).alias("sender"), F.col("m.timestamp_ms").alias("_ms"), F.expr("m.timestamp_ms div 1000").alias("ts"), tx.repaired(F.col("m.content")).alias("content"))
    place = F.row_number().over(w).cast("long")
    return rows.select("thread", "title", "sender", "ts", "content", place.alias("place"), F.when(place > 1, place - 1).alias("previous"))


def comments(files: DataFrame) -> DataFrame:
    """(ts, title, content) from comment exports (value: a JSON object a row), of either of their two shapes."""
    c = files.select(F.from_json("value", COMMENT).alias("c")).select("c.*")
    inner = F.get("data", F.lit(0))["comment"]
    content = tx.repaired(F.coalesce(F.col("string_map_data.Comment.value"), inner["comment"]))
    return c.select(F.coalesce("string_map_data.Time.timestamp", inner["timestamp"], "timestamp").alias("ts"), tx.repaired(F.col("title")).alias("title"), content.alias("content")).filter("content is not null")


def posts(files: DataFrame) -> DataFrame:
    """(id, content, created_at, parent): posts of script-wrapped part files; the parent is what is replied to, else what is quoted."""
    t = files.select(F.explode(F.from_json(unwrapped(F.col("value")), POST)).alias("t")).select("t.tweet.*")
    return t.select(F.col("id_str").alias("id"), F.col("full_text").alias("content"), "created_at", F.coalesce("in_reply_to_status_id_str", "quoted_status_id_str").alias("parent"))


def direct_messages(files: DataFrame) -> DataFrame:
    """(thread, id, sender, content, ts, previous): direct messages in order of time, each with the one before."""
    t = files.select(F.explode(F.from_json(unwrapped(F.col("value")), DIRECT)).alias("t")).select(F.col("t.dmConversation.conversationId").alias("thread"), F.explode("t.dmConversation.messages").alias("m"))
    m = t.select("thread", F.col("m.messageCreate.*")).filter("id is not null")
    rows = m.select("thread", "id", F.col("senderId").alias("sender"), F.col("text").alias("content"), F.unix_timestamp(F.try_to_timestamp("createdAt")).alias("ts"))
    return rows.withColumn("previous", F.lag("id").over(Window.partitionBy("thread").orderBy("ts", "id")))


def contexts(map_files: DataFrame, old_lines: DataFrame) -> DataFrame:
    """(id, status, text): what is known of posts from elsewhere, from a JSON map a file and from older line-wise files; of several the map is first. An entry with an error is a ghost."""
    entry = "struct<text:string,error:string>"
    new = map_files.select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("id", "e")).select("id", "e.*", F.lit(0).alias("_p"))
    old = old_lines.select(F.from_json("value", "id string, text string, error string").alias("e")).select("e.*", F.lit(1).alias("_p")).select("id", "text", "error", "_p")
    first = new.unionByName(old).filter("id is not null").groupBy("id").agg(F.min_by(F.struct("text", "error"), F.struct("_p", F.coalesce("text", F.lit("")))).alias("e"))
    return first.select("id", F.when(F.col("e.error").isNotNull(), "ghost").otherwise("known").alias("status"), F.col("e.text").alias("text"))


def csv_messages(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a chat history in CSV with a header; quoted fields may hold line ends and doubled quotes."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def conversation_threads(spark: SparkSession, path: str) -> DataFrame:
    """(item): the elements of conversation_thread of JSON documents, one document a line, as text each."""
    return spark.read.text(path).select(F.explode(F.from_json("value", "conversation_thread array<string>")["conversation_thread"]).alias("item"))


# Fixed value: how many levels of a comment tree are read at once.
DEPTHS = 4


def _node(levels: int) -> str:
    """The type of a comment with replies down to `levels`; those below stay JSON."""
    inner = "string"
    for _ in range(levels - 1):
        inner = f"struct<{NODE.format(inner)}>"
    return NODE.format(inner)


def _with_replies(rows: DataFrame, replies: str, kind: str) -> DataFrame:
    """Each row once as it is (`own`) and once for each of its replies (`c`)."""
    own = F.array(F.lit(None).cast(kind))
    return rows.select("*", F.posexplode(F.concat(own, F.coalesce(replies, F.array().cast(f"array<{kind}>")))).alias("k", "c")).withColumn("own", F.col("k") == 0)


def _comment_rows(level: DataFrame) -> DataFrame:
    """(thread, parent, depth, id, author, body, created_utc, tree) of comments (thread, parent, depth, tree) and the replies of a few levels; for replies below a row with tree alone. A comment without id goes, with what is under it."""
    corrupt = F.col("n._corrupt_record").isNotNull()
    read = level.withColumn("n", F.from_json("tree", f"struct<{_node(DEPTHS)},_corrupt_record:string>", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    read = read.select("*", F.explode_outer(F.when(corrupt, F.array(F.from_json("tree", f"struct<{_node(1)}>")))).alias("one")).withColumn("n", F.when(~corrupt, F.col("n")))  # by explode, so that it is read once, not for each field
    said, fields = ("thread", "parent", "depth"), ("id", "author", "body", "created_utc")
    rows = read.select(*said, *(F.coalesce(f"n.{f}", f"one.{f}").alias(f) for f in fields), F.col("n.replies").alias("replies"), F.col("one.replies").alias("rest")).filter("id is not null")
    own = F.col("own")
    up = (F.when(own, F.col("parent")).otherwise(F.col("id")).alias("parent"), F.when(own, F.col("depth")).otherwise(F.col("depth") + 1).alias("depth"))
    for left in range(DEPTHS - 1, 0, -1):
        each = _with_replies(rows, "replies", f"struct<{_node(left)}>")
        if left > 1:
            below = (F.when(~own, F.col("c.replies")).alias("replies"), F.when(own, F.col("rest")).alias("rest"))
        else:
            below = (F.when(own, F.col("rest")).otherwise(F.col("c.replies")).alias("rest"),)
        rows = each.select("thread", *up, *(F.when(own, F.col(f)).otherwise(F.col(f"c.{f}")).alias(f) for f in fields), *below).filter("id is not null")
    return _with_replies(rows, "rest", "string").filter("own or c is not null").select("thread", *up, *(F.when(own, F.col(f)).alias(f) for f in fields), F.col("c").alias("tree"))


def flattened_comments(trees: DataFrame, thread: str = "thread", tree: str = "tree") -> DataFrame:
    """(thread, id, author, body, ts, parent, depth) of comment trees (thread, tree: the JSON of a root comment). A few levels are read at once, what is below them stays JSON until its turn, so depth has no bound. Where a field in those levels is not of its type, the comment is read by itself and its replies one by one, so that they are not lost with it."""
    from .shared import Levels

    level = trees.select(F.col(thread).alias("thread"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.col(tree).alias("tree"))
    levels, at = Levels(trees.sparkSession, "comments"), 0
    while True:
        level = levels.add(at, _comment_rows(level)).filter("tree is not null")
        if level.isEmpty():
            return levels.all().filter("id is not null").select("thread", "id", "author", "body", F.col("created_utc").alias("ts"), "parent", "depth")
        at += 1


def ancestors(rows: DataFrame, thread: str, seed: str, chain: str) -> DataFrame:
    """(thread, k, ancestor, parent): a list of ancestors, nearest first, as a chain from the furthest, whose parent is the seed."""
    far = rows.select(thread, seed, F.posexplode(F.reverse(chain)).alias("k", "ancestor"))
    before = F.lag("ancestor").over(Window.partitionBy(thread).orderBy("k"))
    return far.select(thread, "k", "ancestor", F.coalesce(before, F.col(seed)).alias("parent"))


def channel(files: DataFrame) -> DataFrame:
    """(channel, id, author, ts, content, parent) from exported channels. Messages without content, attachment and embed go; embeds' titles and texts follow the content."""
    f = files.select(F.from_json("value", CHANNEL).alias("c")).select("c.channel", F.explode("c.messages").alias("m"))
    n = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    kept = f.filter((F.trim(F.coalesce("m.content", F.lit(""))) != "") | n(F.col("m.attachments")) | n(F.col("m.embeds")))
    embeds = F.transform(F.coalesce("m.embeds", F.array().cast("array<struct<title:string,description:string>>")), lambda e: F.concat_ws(" ", e["title"], e["description"]))
    content = F.concat_ws("\n", F.when(F.trim("m.content") != "", F.col("m.content")), F.when(F.size(embeds) > 0, F.array_join(embeds, "\n")))
    return kept.select(F.col("channel.id").alias("channel"), F.col("m.id").alias("id"), F.col("m.author.name").alias("author"), F.unix_timestamp(F.try_to_timestamp("m.timestamp")).alias("ts"), content.alias("content"), F.col("m.reference.messageId").alias("parent"))


def kept_message(kind: Column, text: Column) -> Column:
    """Whether a store's message is one to keep: no system note (type 7) and not without text."""
    return F.coalesce(kind != 7, F.lit(True)) & (F.trim(F.coalesce(text, F.lit(""))) != "")


def store_messages(messages: DataFrame, chats_: DataFrame, revoked: DataFrame) -> DataFrame:
    """(message_id, chat_id, title, ts, text): a messenger store's kept messages with their chats, those revoked left out. messages: (message_id, chat_id, kind, ts, text)."""
    kept = messages.filter(kept_message(F.col("kind"), F.col("text"))).join(revoked.select("message_id"), "message_id", "left_anti")
    return kept.join(chats_.select("chat_id", "title"), "chat_id").select("message_id", "chat_id", "title", "ts", "text")


def cards(files: DataFrame) -> DataFrame:
    """(number, name): the last ten digits of each telephone number of vCard files (value: a whole file) and the card's name, unescaped; of several names of a number the smallest."""
    one = files.select(F.explode(F.split("value", r"(?m)^BEGIN:VCARD\s*$")).alias("card"))
    name = F.regexp_extract("card", r"(?m)^FN[^:\n]*:(.*?)\r?$", 1)
    clean = F.regexp_replace(F.regexp_replace(name, r"\\n", " "), r"\\([,;])", "$1")
    numbers = F.transform(F.regexp_extract_all("card", F.lit(r"(?m)^TEL[^:\n]*:(.*?)\r?$"), F.lit(1)), lambda t: F.substring(F.regexp_replace(t, "[^0-9]", ""), -10, 10))
    rows = one.select(F.trim(clean).alias("name"), F.explode(numbers).alias("number")).filter("length(number) = 10 and name <> ''")
    return rows.groupBy("number").agg(F.min("name").alias("name"))


def graph_csv(spark: SparkSession, path: str) -> DataFrame:
    """Graph tables: all fields quoted, quotes doubled, line ends inside."""
    return csv_messages(spark, path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, compressed or not."""
    return spark.read.schema(schema).json(path)


def identity_map(spark: SparkSession, own: str, fallback: str) -> dict:
    """A small configuration in JSON: the user's own file, or where it is missing the one that comes with the program."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    import json

    return json.loads(spark.read.text(own if there else fallback, wholetext=True).first()["value"])  # one small file


def appended_after(rows: DataFrame, key: str, mark: int) -> DataFrame:
    """Rows with a key over the high-water mark."""
    return rows.filter(F.col(key) > mark)
