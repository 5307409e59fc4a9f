"""WARC archives written and read as a chunked record table.

Writing: each record is laid out as its WARC/1.1 bytes in rows of Spark's text writer (the line end after a row is the
last byte of the record's closing CRLF CRLF), in gzip files, which readers take whole and in order. A payload of more than
`segment` bytes is written as WARC's segments: a first record and continuations of at most so many bytes each, so that no
line of the archive is longer, line ends in the payload or not. Of records with equal payloads the one with the largest id
is the response; the others are revisits that refer to it and carry its digest. Payloads aren't shuffled for that: ids and
digests are, and what repeats comes back by a broadcast of checked size.

Reading: a task streams the lines of its files through a small state machine that counts Content-Length bytes, so lines
in a payload that look like headers do no harm. A payload leaves it as rows (record, chunk number, bytes) of at most
`chunk` bytes; each row carries the byte count and SHA-1 so far, over segments too, the last one those of the whole
payload. No more than a line and a chunk is held. In archives by other writers a payload without line ends and segments is
one line of its size.

Results: a null payload is an empty one. Rows that repeat id and payload are one record. A null id sorts below all
others; records that share an id but not the payload stay apart. Line ends in a URI become spaces. Other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Payload bytes of one record at most; more go on in continuation records.
SEGMENT = 1 << 20
#: Digests that repeat are broadcast up to so many (some 20 MB); more meet the pages by a shuffle.
BROADCAST_ROWS = 200_000


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a SHA-1 in hex: five hex digits are four base32 digits."""
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _some(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """(page_id, url, payload, bytes, sha1, sha2, kind, refers_to): which record each page becomes, once for rows that repeat id and payload. Payloads under `least` bytes are all responses."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("sha2"))
    names = stored(rows.select("page_id", "sha2").groupBy("page_id", "sha2").agg(F.count("*").alias("n"), F.lit(1).alias("one")), "names")
    several = stored(names.groupBy("sha2").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).filter("n > 1").select(F.col("sha2").alias("_sha2"), "best"), "several")
    again = names.filter("n > 1").select(F.col("page_id").alias("_page"), F.col("sha2").alias("_again"))
    if again.isEmpty():
        once = rows
    else:  # only rows that repeat are shuffled to become one
        again = _some(stored(again, "again"))
        on = rows.page_id.eqNullSafe(F.col("_page")) & (rows.sha2 == F.col("_again"))
        once = rows.join(again, on, "left_anti").unionByName(rows.join(again, on, "left_semi").dropDuplicates(["page_id", "sha2"]))
    joined = once.join(_some(several), once.sha2 == F.col("_sha2"), "left")
    revisit = (F.col("bytes") >= least) & F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    return joined.select("page_id", "url", "payload", "bytes", F.sha1("payload").alias("sha1"), "sha2", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("best")).alias("refers_to"))


def _laid_out(rows: DataFrame, segment: int) -> DataFrame:
    """(value): the bytes of each record but the last line end; a record in segments is as many rows, one after another."""
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(":"), F.col("sha1"), F.lit(">"))
    own, revisit = name(F.col("page_id")), F.col("kind") == "revisit"
    more = F.col("part") > 0
    held = F.when(revisit, 0).otherwise(F.col("bytes"))
    parts = F.greatest(F.lit(1), F.ceil(held / segment)).cast("int")
    dealt = rows.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    piece = F.when(revisit, F.lit(b"")).otherwise(F.substring("payload", F.col("part") * segment + 1, F.lit(segment)))
    http = F.when(more, "").otherwise(F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF)))
    field = lambda key, value: F.concat(F.lit(f"{CRLF}{key}: "), value)
    where = [field("WARC-Date", F.lit(DATE)), field("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " "))]
    segments = F.when(F.col("parts") > 1, F.concat(field("WARC-Segment-Number", (F.col("part") + 1).cast("string")), F.when(more, field("WARC-Segment-Origin-ID", own)).otherwise(""), F.when(F.col("part") + 1 == F.col("parts"), field("WARC-Segment-Total-Length", F.col("bytes").cast("string"))).otherwise(""))).otherwise("")
    refers = F.when(revisit, F.concat(field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), field("WARC-Refers-To", name(F.col("refers_to"))))).otherwise("")
    head = F.concat(
        F.lit("WARC/1.1"), field("WARC-Type", F.when(more, "continuation").otherwise(F.col("kind"))),
        field("WARC-Record-ID", F.when(more, F.concat(F.lit("<urn:segment:"), (F.col("part") + 1).cast("string"), F.lit(":"), own, F.lit(">"))).otherwise(own)), *where,
        F.when(more, "").otherwise(field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha1"))))), refers, segments,
        F.when(more, "").otherwise(field("Content-Type", F.lit("application/http; msgtype=response"))), field("Content-Length", (F.octet_length(http) + F.octet_length(piece)).cast("string")), F.lit(CRLF + CRLF), http,
    )
    return dealt.select(F.concat(head.cast("binary"), piece, F.lit((CRLF + "\r").encode())).cast("string").alias("value"))


def write(rows: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Write what records() returns as WARC files under path."""
    _laid_out(rows, segment).write.option("compression", "gzip").option("lineSep", "\n").text(path)


class _Reader:
    """The state machine: fed lines without their line ends, it appends finished chunks to rows."""

    def __init__(self, chunk: int, with_data: bool):
        self.chunk, self.with_data, self.rows = chunk, with_data, []
        self.open = False  # a record whose continuations are still to come
        self._expect_record()

    def _expect_record(self) -> None:
        self.state, self.head = "start", {}

    def line(self, line: bytes) -> None:
        if self.state == "start":
            if line == b"\r":  # the CRLFs after a block
                return
            if line != b"WARC/1.1\r":
                raise ValueError(f"no record begins with {line[:40]!r}")
            self.state = "head"
        elif self.state == "head":
            if line != b"\r":
                key, _, value = line.partition(b":")
                self.head[key.lower()] = value.strip().decode()
                return
            self._begin()
        else:
            whole = len(line) < self.left
            part = memoryview(line)[: self.left]
            self.left -= len(part) + whole
            if self.state == "http":
                if part == b"\r" and whole:
                    self.state = "payload"
            else:
                self._take(part)
                if whole:
                    self._take(b"\n")
            if not self.left:
                self._end()

    def _begin(self) -> None:
        self.left = int(self.head[b"content-length"])
        if self.head[b"warc-type"] == "continuation":
            if not self.open or self.head.get(b"warc-segment-origin-id") != self.record[0]:
                raise ValueError("a continuation without its record")
            self.state = "payload"
        else:
            if self.open:
                raise ValueError("a record ends without its last segment")
            self.record = (self.head[b"warc-record-id"], self.head[b"warc-type"], self.head.get(b"warc-refers-to"), self.head.get(b"warc-payload-digest", "").removeprefix("sha1:"))
            self.state, self.number, self.size, self.sha, self.buffer = "http", 0, 0, hashlib.sha1(), bytearray()
        self.open = b"warc-segment-number" in self.head and b"warc-segment-total-length" not in self.head
        if not self.left:
            self._end()

    def _take(self, part) -> None:
        for at in range(0, len(part), self.chunk):
            piece = part[at : at + self.chunk]
            if len(self.buffer) + len(piece) > self.chunk:
                self._emit(False)
            self.buffer += piece

    def _emit(self, last: bool) -> None:
        self.sha.update(self.buffer)
        self.size += len(self.buffer)
        if last or self.with_data:
            digest = base64.b32encode(self.sha.digest()).decode()
            self.rows.append((*self.record, self.number, last, bytes(self.buffer) if self.with_data else None, self.size, digest))
        self.number += 1
        self.buffer = bytearray()

    def _end(self) -> None:
        if not self.open:
            self._emit(True)
        self._expect_record()


SCHEMA = "record_id string, kind string, refers_to string, stated_digest string, chunk_no int, last boolean, data binary, bytes_so_far long, sha1_so_far string"


def read_chunks(spark: SparkSession, path: str, chunk: int = 1 << 16, with_data: bool = True) -> DataFrame:
    """The chunk table of all archives under path. Without data only the last row of each record comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(chunk, with_data)
        types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.string()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for b in batches:
            for line in b.column(0):
                reader.line(line.as_py())
                if len(reader.rows) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*reader.rows, strict=True), types, strict=True)], names=names)
                    reader.rows.clear()
        if reader.state != "start" or reader.open:
            raise ValueError("an archive ends inside a record")
        if reader.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*reader.rows, strict=True), types, strict=True)], names=names)

    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary"))
    return lines.mapInArrow(run, SCHEMA)


def page_table(chunks: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record, from the chunk table, which is read once. A revisit's payload is measured where it is stored, at the record it refers to."""
    number = lambda c: F.when(F.regexp_extract(c, "^<urn:page:([^:]*):", 1) != "none", F.regexp_extract(c, "^<urn:page:([^:]*):", 1)).cast("long")
    ends = stored(chunks.filter("last").select("record_id", "kind", "refers_to", "bytes_so_far", "sha1_so_far"), "ends")
    out = lambda n, d, refers: [number("record_id").alias("page_id"), n.alias("payload_bytes"), d.alias("payload_digest"), F.col("kind").alias("record_type"), refers.cast("long").alias("refers_to")]
    own = ends.filter("kind = 'response'")
    asked = ends.filter("kind = 'revisit'").select(F.col("refers_to").alias("record_id")).distinct()
    targets = stored(own.join(asked, "record_id", "left_semi").select(F.col("record_id").alias("target"), F.col("bytes_so_far").alias("n"), F.col("sha1_so_far").alias("d")), "targets")
    again = ends.filter("kind = 'revisit'").join(_some(targets), F.col("refers_to") == F.col("target"))
    return own.select(*out(F.col("bytes_so_far"), F.col("sha1_so_far"), F.lit(None))).unionByName(again.select(*out(F.col("n"), F.col("d"), number("refers_to"))))
