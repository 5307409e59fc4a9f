"""Phrases whose words stand together more often than their parts suggest, counted exactly by counting quotient filters.

Words that occur `least` times or more in their language get a number; texts become runs of such numbers. Runs of n numbers
are counted for n = 2 to `longest`, one level after another. A level packs an n-gram's numbers into 64-bit words and
scrambles them invertibly, so that keys spread evenly and nothing is lost. The leading bits name a block; the next bits are
the quotient, which a filter keeps as one unary mark a slot; the rest, the full remainder, stands in the slot with a counter
of one byte, larger counts behind. Each task fills a filter of bounded size and sends it in blocks; the sorted blocks of all
tasks are merged, one block at a time, and n-grams with `least` occurrences are unscrambled again. An n-gram is only counted
where both (n-1)-grams inside it pass a bitmap of the frequent ones. The bitmap has 2 ** BITMAP_BITS bits at most: false
passes cost counting, never results.

What is sent grows with the distinct n-grams of frequent words in a task, not with how often one occurs, so a phrase that
stands in a third of all texts is one slot of each task. Numbers are given by broadcast while there are at most `dictionary`
words, else by a join of all words; both give the same rows.

Results: a null text is empty, a null language is `und` and goes together with texts that say `und`. Repeated rows and ids
count each; ids are not read. Texts without words give nothing; an empty table gives no rows. Other columns are not read,
whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, lower_ascii, mix, released, slices, stored, text_bytes

CUTS = b".,;:!?\n\x0b\x0c\r"
BITMAP_BITS = 27
#: Words that are broadcast at most (some 100 MB as a Python dictionary).
DICTIONARY = 500_000
#: Distinct n-grams that a task holds before it sends them.
HELD = 1 << 21
#: N-grams of a block, repeats in several tasks included, that the number of blocks aims at.
BLOCK = 1 << 19
_CUT, _INSIDE = np.zeros(256, bool), np.ones(256, bool)
_CUT[list(CUTS)] = True
_INSIDE[list(CUTS + b" \t")] = False


def split(texts) -> tuple:
    """(words, document, piece) of an Arrow array of texts: words as an Arrow array, for each its document and a number that neighbours share within a piece only."""
    import pyarrow as pa

    raw, at = text_bytes(texts)
    raw = lower_ascii(raw)
    inside = _INSIDE[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[inside]))])
    doc = np.searchsorted(at, starts, side="right") - 1
    return words, doc, np.cumsum(_CUT[raw])[starts] + doc if len(raw) else doc


def _languages(column) -> tuple:
    import pyarrow.compute as pc

    coded = pc.fill_null(column.cast("string"), "und").dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, word, c) of all words."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 0, 1 << 21):
                words, doc, _ = split(part.column(0))
                coded = words.dictionary_encode()
                langs, of = _languages(part.column(1))
                each, n = np.unique(of[doc].astype(np.int64) * len(coded.dictionary) + coded.indices.to_numpy(), return_counts=True)
                if len(each):
                    yield pa.RecordBatch.from_arrays([langs.take(pa.array(each // len(coded.dictionary))), coded.dictionary.take(pa.array(each % len(coded.dictionary))).cast("string"), pa.array(n)], ["lang", "word", "c"])
        released()

    each = docs.select(F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l")).mapInArrow(run, "lang string, word string, c long")
    return each.groupBy("lang", "word").agg(F.sum("c").alias("c"))


def numbered(words: DataFrame) -> DataFrame:
    """words with an id from 1 without gaps: ranks inside parts of some 50,000 words, and the counts of the parts before."""
    parts = max(1, words.count() // 50_000)
    words = words.withColumn("_p", F.pmod(F.xxhash64("lang", "word"), F.lit(parts)))
    before = words.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("lang", "word"))
    return words.withColumn("_r", rank).join(before, "_p").select("lang", "word", "c", (F.col("_r") + F.col("_before")).cast("int").alias("id"))


def _runs(ids: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Runs of two or more numbered words of one piece, a 0 before each."""
    link = np.zeros(len(ids) + 1, bool)
    link[1:-1] = (ids[1:] > 0) & (ids[:-1] > 0) & (piece[1:] == piece[:-1])
    kept = np.flatnonzero(link[:-1] | link[1:])
    begins = ~link[kept]
    out = np.zeros(len(kept) + int(begins.sum()), np.int32)
    out[np.arange(len(kept)) + np.cumsum(begins)] = ids[kept]
    return out


def encoded(docs: DataFrame, words: DataFrame, text: str = "text", lang: str = "lang", dictionary: int = DICTIONARY) -> DataFrame:
    """(runs): blobs of 32-bit numbers, the runs of numbered words of many texts with zeros between."""
    import pyarrow as pa

    body = docs.select(F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l"))
    if words.count() > dictionary:
        return _encoded_by_join(body, words)
    by_lang: dict[str, dict[str, int]] = {}
    for row in words.select("lang", "word", "id").toLocalIterator():
        by_lang.setdefault(row.lang, {})[row.word] = row.id

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, 0, 1 << 21):
                tokens, doc, piece = split(part.column(0))
                coded = tokens.dictionary_encode()
                langs, of = _languages(part.column(1))
                known = coded.dictionary.to_pylist()
                table = np.zeros((len(langs), len(known)), np.int32)
                for k, name in enumerate(langs.to_pylist()):
                    get = by_lang.get(name, {}).get
                    table[k] = [get(w, 0) for w in known]
                held.append(_runs(table[of[doc], coded.indices.to_numpy()], piece))
                size += len(held[-1])
                if size > 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()], pa.binary())], ["runs"])
                    held, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()], pa.binary())], ["runs"])
        released()

    return body.mapInArrow(run, "runs binary")


def _encoded_by_join(body: DataFrame, words: DataFrame) -> DataFrame:
    """Numbers by a join: words go out as rows and those with a number come back by slices of the input, half a megabyte of texts or one text."""

    def out(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part_no, stretch = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, 0, 1 << 19):
                tokens, doc, piece = split(part.column(0))
                langs, of = _languages(part.column(1))
                n = len(tokens)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part_no, np.int64)), pa.array(np.full(n, stretch, np.int64)), pa.array(np.arange(n)), pa.array(piece.astype(np.int64)), langs.take(pa.array(of[doc])), tokens.cast("string")], ["task", "stretch", "at", "piece", "lang", "word"])
                stretch += 1
        released()

    def back(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.column(0):
                at, piece, ids = (row.values.field(k).to_numpy() for k in range(3))
                # a word without a number is absent: a gap in the places
                order = np.argsort(at)
                at, piece, ids = at[order], piece[order], ids[order]
                blob = _runs(ids, piece + np.cumsum(np.diff(at, prepend=at[:1]) != 1))
                if len(blob):
                    yield pa.RecordBatch.from_arrays([pa.array([blob.astype(np.int32).tobytes()], pa.binary())], ["runs"])

    each = body.mapInArrow(out, "task long, stretch long, at long, piece long, lang string, word string")
    both = each.join(words.select("lang", "word", "id"), ["lang", "word"])
    return both.groupBy("task", "stretch").agg(F.collect_list(F.struct("at", "piece", "id")).alias("x")).select("x").mapInArrow(back, "runs binary")


class Keys:
    """N-grams as scrambled words of 64 bits."""

    def __init__(self, n: int, most: int):
        self.n, self.bits = n, max(1, int(most).bit_length())
        self.per = 64 // self.bits
        self.words = -(-n // self.per)

    def of(self, runs: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        columns = []
        for w in range(self.words):
            packed = np.zeros(len(at), np.uint64)
            for k in range(w * self.per, min(self.n, (w + 1) * self.per)):
                packed = (packed << np.uint64(self.bits)) | runs[at + k].astype(np.uint64)
            columns.append(packed)
        return self.scrambled(columns)

    def scrambled(self, columns: list[np.ndarray]) -> list[np.ndarray]:
        for w in range(len(columns) - 1, 0, -1):
            columns[w] = mix(columns[w])
            columns[w - 1] = columns[w - 1] ^ columns[w]
        columns[0] = mix(columns[0])
        return columns

    def numbers(self, columns: list[np.ndarray]) -> np.ndarray:
        """The reverse of `of`: an array of n numbers a row."""
        columns = [unmix(c) for c in columns]
        for w in range(1, len(columns)):
            columns[w - 1] = columns[w - 1] ^ mix(columns[w])
        out, mask = np.zeros((len(columns[0]), self.n), np.int32), np.uint64((1 << self.bits) - 1)
        for k in range(self.n):
            w = k // self.per
            inside = min(self.n, (w + 1) * self.per) - 1 - k
            out[:, k] = ((columns[w] >> np.uint64(inside * self.bits)) & mask).astype(np.int32)
        return out


_BACK = pow(0xD6E8FEB86659FD93, -1, 1 << 64)


def unmix(x: np.ndarray) -> np.ndarray:
    """The reverse of common.mix."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(_BACK)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(_BACK)
        return x ^ (x >> np.uint64(32))


def summed(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys in order, once each, and their sums. Runs that are in order are merged rather than sorted (a stable sort finds them)."""
    if not len(n):
        return columns, n
    order = np.argsort(columns[0], kind="stable") if len(columns) == 1 else np.lexsort(columns[::-1])
    columns, n = [c[order] for c in columns], n[order]
    new = np.ones(len(n), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.add.reduceat(n, at)


def packed(columns: list[np.ndarray], n: np.ndarray, lead: int) -> bytes:
    """A filter of keys in order that share their `lead` leading bits: unary marks of the quotients' runs, full remainders, counters of a byte and the larger ones behind."""
    m = len(n)
    q = min(m.bit_length(), 64 - lead)
    rest = 64 - lead - q
    inner = columns[0] & np.uint64((1 << (64 - lead)) - 1) if lead else columns[0]
    quotient = (inner >> np.uint64(rest)).astype(np.int64) if rest < 64 else np.zeros(m, np.int64)
    marks = np.zeros(m + (1 << q), bool)
    marks[quotient + np.arange(m)] = True  # slots of a run are ones, a zero ends each quotient
    width = -(-rest // 8)
    low = (inner & np.uint64((1 << rest) - 1)).astype(">u8").view(np.uint8).reshape(m, 8)[:, 8 - width :]
    large = n >= 255
    head = np.array([m, q, int(large.sum()), len(columns)], np.int32)
    return b"".join([head.tobytes(), np.packbits(marks).tobytes(), low.tobytes(), *(c.astype("<u8").tobytes() for c in columns[1:]), np.where(large, 255, n).astype(np.uint8).tobytes(), n[large].astype("<i8").tobytes()])


def unpacked(blob: bytes, lead: int, block: int) -> tuple[list[np.ndarray], np.ndarray]:
    m, q, large, count = (int(x) for x in np.frombuffer(blob, np.int32, 4))
    at, rest = 16, 64 - lead - q
    size = -(-(m + (1 << q)) // 8)
    marks = np.unpackbits(np.frombuffer(blob, np.uint8, size, at), count=m + (1 << q)).astype(bool)
    at += size
    quotient = (np.flatnonzero(marks) - np.arange(m)).astype(np.uint64)
    width = -(-rest // 8)
    low = np.zeros((m, 8), np.uint8)
    low[:, 8 - width :] = np.frombuffer(blob, np.uint8, m * width, at).reshape(m, width)
    at += m * width
    first = low.view(">u8").ravel().astype(np.uint64) | (quotient << np.uint64(rest) if rest < 64 else np.uint64(0))
    columns = [first | np.uint64(block << (64 - lead)) if lead else first]
    for _ in range(count - 1):
        columns.append(np.frombuffer(blob, "<u8", m, at))
        at += 8 * m
    n = np.frombuffer(blob, np.uint8, m, at).astype(np.int64)
    n[n == 255] = np.frombuffer(blob, "<i8", large, at + m)
    return columns, n


def _places(runs: np.ndarray, n: int, most: int, bitmap: np.ndarray | None, bits: int) -> np.ndarray:
    """Where n-grams begin that may be frequent."""
    if len(runs) < n:
        return np.zeros(0, np.int64)
    inside = np.ones(len(runs) - n + 2, bool)
    for k in range(n - 1):
        inside &= runs[k : len(runs) - n + 2 + k] > 0
    at = np.flatnonzero(inside)
    if bitmap is not None:
        mark = Keys(n - 1, most).of(runs, at)[0] >> np.uint64(64 - bits)
        inside[at[~((bitmap[(mark >> np.uint64(3)).astype(np.int64)] >> (mark & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)]] = False
        # a frequent (n-1)-gram here and at the next place
        return np.flatnonzero(inside[:-1] & inside[1:])
    return np.flatnonzero(inside[:-1] & (runs[n - 1 :] > 0))


def counted(runs: DataFrame, n: int, most: int, lead: int, least: int, bitmap: np.ndarray | None = None, bits: int = 0) -> DataFrame:
    """(ids, a, mark) of the n-grams with `least` occurrences or more; mark has the leading bits of the scrambled key."""
    keys = Keys(n, most)

    def fill(batches):
        import pyarrow as pa

        def sent(columns, c):
            block = (columns[0] >> np.uint64(64 - lead)).astype(np.int64)
            cuts = [*np.flatnonzero(np.diff(block, prepend=-1)).tolist(), len(c)]
            for a, z in zip(cuts, cuts[1:]):
                yield pa.RecordBatch.from_arrays([pa.array([block[a]], pa.int32()), pa.array([packed([x[a:z] for x in columns], c[a:z], lead)], pa.binary())], ["block", "filter"])

        held, size = [], 0
        for batch in batches:
            for blob in batch.column(0):
                run = np.frombuffer(blob.as_buffer(), np.int32)
                at = _places(run, n, most, bitmap, bits)
                if len(at):
                    held.append(summed(keys.of(run, at), np.ones(len(at), np.int64)))
                    size += len(held[-1][1])
                if size > HELD:
                    held = [summed([np.concatenate(x) for x in zip(*(h[0] for h in held))], np.concatenate([h[1] for h in held]))]
                    size = len(held[0][1])
                    if size > HELD // 2:
                        yield from sent(*held[0])
                        held, size = [], 0
        if held:
            yield from sent(*summed([np.concatenate(x) for x in zip(*(h[0] for h in held))], np.concatenate([h[1] for h in held])))
        released()

    def merge(key, table):
        import pyarrow as pa

        block = key[0].as_py()
        each = [unpacked(x.as_py(), lead, block) for x in table.column("filter")]
        columns, c = summed([np.concatenate(x) for x in zip(*(e[0] for e in each))], np.concatenate([e[1] for e in each]))
        columns, c = [x[c >= least] for x in columns], c[c >= least]
        mark = (columns[0] >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
        ids = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(c) + 1, n, dtype=np.int32)), pa.array(keys.numbers(columns).ravel(), pa.int32()))
        return pa.table({"ids": ids, "a": pa.array(c, pa.int64()), "mark": pa.array(mark, pa.int64())})

    return runs.mapInArrow(fill, "block int, filter binary").groupBy("block").applyInArrow(merge, "ids array<int>, a long, mark long")


def _bitmap(grams: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of the leading bits of frequent keys, at least 32 bits a key up to the whole size; the driver gets 2 ** (BITMAP_BITS - 3) bytes at most."""
    bits = min(BITMAP_BITS, max(15, (32 * grams.count()).bit_length()))
    mark = F.shiftright("mark", BITMAP_BITS - bits)
    parts = grams.groupBy(F.shiftright(mark, 15).alias("part")).agg(F.bitmap_construct_agg(mark.bitwiseAND(F.lit((1 << 15) - 1))).alias("map"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in parts.collect():
        out[row.part << 12 : (row.part + 1) << 12] = np.frombuffer(row.map, np.uint8)
    return out, bits


def phrases(docs: DataFrame, least: int = 100, longest: int = 5, text: str = "text", lang: str = "lang", dictionary: int = DICTIONARY) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score, cut) of all phrases of 2 to `longest` words with `least` occurrences that no longer phrase holds as often. score is exact: floor(1000 * a * n / (l * r)) at the cut where it is least."""
    counts = stored(word_counts(docs, text, lang), "words")
    sizes = counts.groupBy("lang").agg(F.sum("c").alias("n"))
    words = stored(numbered(counts.filter(F.col("c") >= least)), "numbers")
    most = words.count()
    runs = stored(encoded(docs, words, text, lang, dictionary), "runs")
    total = runs.agg(F.coalesce(F.sum(F.octet_length("runs")), F.lit(0))).first()[0] // 4
    lead = max(5, (total // BLOCK).bit_length())
    levels, bitmap, bits = [words.select(F.array("id").alias("ids"), F.col("c").alias("a"))], None, 0
    for n in range(2, longest + 1):
        grams = stored(counted(runs, n, most, lead, least, bitmap, bits), f"grams-{n}")
        levels.append(grams.select("ids", "a"))
        if grams.isEmpty():
            break
        if n < longest:
            bitmap, bits = _bitmap(grams)
    discard(runs)
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    size = F.size("ids")
    inner = every.filter(size > 2).select(F.explode(F.array(F.slice("ids", F.lit(1), size - 1), F.slice("ids", F.lit(2), size - 1))).alias("ids"), F.col("a").alias("longer")).groupBy("ids").agg(F.max("longer").alias("longer"))
    kept = every.filter(size > 1).join(inner, "ids", "left").filter(F.coalesce(F.col("longer"), F.lit(0)) < F.col("a")).select("ids", "a")
    cuts = kept.select("ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    cuts = cuts.select("*", F.slice("ids", F.lit(1), F.col("cut")).alias("left"), F.slice("ids", F.col("cut") + 1, F.size("ids") - F.col("cut")).alias("right"))
    cuts = cuts.join(every.select(F.col("ids").alias("left"), F.col("a").alias("l")), "left").join(every.select(F.col("ids").alias("right"), F.col("a").alias("r")), "right")
    first = words.join(sizes, "lang").select(F.col("id").alias("first"), "lang", "n")
    cuts = cuts.join(first, F.get("ids", F.lit(0)) == F.col("first"))
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = cuts.withColumn("above", (F.lit(1000) * F.col("a")).cast("decimal(19,0)") * wide("n")).withColumn("below", wide("l") * wide("r")).withColumn("score", F.expr("above div below"))
    best = cuts.groupBy("ids").agg(F.min(F.struct("score", "cut", "l", "r", "a", "n", "lang")).alias("x"))
    spelled = kept.select("ids", F.posexplode("ids").alias("k", "id")).join(words.select("id", "word"), "id").groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    return best.join(spelled, "ids").select("x.lang", "phrase", F.size("ids").cast("long").alias("words"), "x.a", "x.l", "x.r", "x.n", "x.score", "x.cut")


def ranked(table: DataFrame, most: int = 2000) -> DataFrame:
    """The first `most` of each language by score, occurrences and spelling."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return table.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).withColumn("rank", F.col("rank").cast("long"))
