"""Token counts of sections from one encoding of the whole document.

A document is encoded once. A token's characters are those whose first byte it has; their numbers add up to the tokens'
character spans. Spans are joined with the sections of the document by interval, and each token is counted where most of
its characters are (rule "most"; of equals the earlier section), where it begins ("start"), or in every section by its
share of characters ("split"). A token inside a character belongs to that character's section. Counts of a document's
sections add up to its tokens. Encoding the sections one by one would give other tokens at their edges.

Sections are the document's lines; the line end belongs to the line before it. The operator also takes named fields: it
encodes them joined by `joint` and counts tokens field by field, the joint belonging to the field before it.

Results: a null or empty text has one section without tokens. Copies and repeated rows are counted alike. Extra columns
stay out. Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

RULES = ("most", "start", "split")
_ENCODERS: dict[str, tuple] = {}


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(ranks_file: str) -> tuple:
    """(tiktoken encoding, characters that begin in each token)"""
    if ranks_file not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        size[list(ranks.values())] = [sum(c & 0xC0 != 0x80 for c in t) for t in ranks]
        _ENCODERS[ranks_file] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), size
    return _ENCODERS[ranks_file]


def attributed(sizes: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, tokens that cross an edge) of each section. sizes: characters of the tokens in order; ends: where the sections end, ascending."""
    last = np.cumsum(sizes)
    first = last - sizes
    a = np.minimum(np.searchsorted(ends, np.where(sizes > 0, first, first - 1), side="right"), len(ends) - 1)
    b = np.minimum(np.searchsorted(ends, last - 1, side="right"), len(ends) - 1)
    n = len(ends)
    over = np.flatnonzero(a != b)
    count = np.bincount(a, minlength=n).astype(np.float64)
    crossing = np.zeros(n, np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    for t in over.tolist():
        touched = np.arange(a[t], b[t] + 1)
        part = np.minimum(ends[touched], last[t]) - np.maximum(begins[touched], first[t])
        crossing[touched] += part > 0
        if rule == "most":
            count[a[t]] -= 1
            count[touched[np.argmax(part)]] += 1
        elif rule == "split":
            count[a[t]] -= 1
            count[touched] += part / sizes[t]
    return count, crossing


def section_counts(docs: DataFrame, fields: tuple[str, ...] = ("text",), joint: str = "\n", lines: bool = True, rule: str = "most", ranks_file: str | None = None, doc_id: str = "doc_id", rows_at_once: int = 500) -> DataFrame:
    """(doc_id, sections): sections is an array of (section, field, bytes, chars, tokens, crossing). With lines, fields split further into their lines."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    small_batches(docs.sparkSession)
    ranks_file = ranks_file or default_ranks()
    kind = pa.list_(pa.struct([("section", pa.int32()), ("field", pa.string()), ("bytes", pa.int64()), ("chars", pa.int64()), ("tokens", pa.float64()), ("crossing", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, size = encoder(ranks_file)
        for whole in batches:
            for at in range(0, whole.num_rows, rows_at_once):
                b = whole.slice(at, rows_at_once)
                upto, section, field, size_of, chars, tokens, crossing = [0], [], [], [], [], [], []
                for row in zip(*(b.column(k + 1).to_pylist() for k in range(len(fields))), strict=True):
                    parts = [(x or "") + (joint if k + 1 < len(fields) else "") for k, x in enumerate(row)]
                    raw = [p.encode() for p in parts]
                    edges, names = [], []
                    base = 0
                    for name, r in zip(fields, raw, strict=True):
                        inner = np.flatnonzero(np.frombuffer(r, np.uint8) == 10) + 1 if lines else np.zeros(0, np.int64)
                        inner = np.append(inner[inner < len(r)], len(r)) + base
                        edges.append(inner)
                        names += [name] * len(inner)
                        base += len(r)
                    ends = np.concatenate(edges)
                    begun = np.concatenate([[0], np.cumsum((np.frombuffer(b"".join(raw), np.uint8) & 0xC0) != 0x80)])
                    at_char = begun[ends]
                    ids = encoding.encode_ordinary("".join(parts))
                    n, c = attributed(size[np.array(ids, np.int64)], at_char, rule) if ids else (np.zeros(len(ends)), np.zeros(len(ends), np.int64))
                    section.append(np.arange(len(ends)))
                    field += names
                    size_of.append(np.diff(ends, prepend=0))
                    chars.append(np.diff(at_char, prepend=0))
                    tokens.append(n)
                    crossing.append(c)
                    upto.append(upto[-1] + len(ends))
                items = pa.StructArray.from_arrays(
                    [pa.array(np.concatenate(section).astype(np.int32)), pa.array(field, pa.string()), pa.array(np.concatenate(size_of)), pa.array(np.concatenate(chars)), pa.array(np.concatenate(tokens)), pa.array(np.concatenate(crossing))], fields=list(kind.value_type)
                )
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), items)], names=["doc_id", "sections"])

    taken = docs.select(F.col(doc_id).alias("doc_id"), *(F.col(f).cast("string").alias(f) for f in fields))
    return taken.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, sections array<struct<section:int,field:string,bytes:long,chars:long,tokens:double,crossing:long>>")


def counts_by_section(table: DataFrame) -> DataFrame:
    """One row a section."""
    return table.select("doc_id", F.explode("sections").alias("s")).select("doc_id", F.col("s.section").alias("section"), F.col("s.field").alias("field"), F.col("s.bytes").alias("n_bytes"), F.col("s.chars").alias("n_chars"), F.col("s.tokens").alias("n_tokens"), F.col("s.crossing").alias("n_crossing"))
