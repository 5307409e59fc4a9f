"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What every contract calls a word: a run of anything but space and the five ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. A session on this machine alone (tests) may name none and gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        found = f"{tempfile.gettempdir()}/keepsake-checkpoints"
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/keepsake/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    small_batches(spark)
    df.write.parquet(path)
    # shuffle files of finished jobs stay until the driver's JVM collects what refers to them
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what stored() wrote, once nothing reads it any more."""
    for df in tables:
        removed(df.sparkSession, df.stored_at)


def removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Python workers of this session get Arrow batches of at most 4 MB from here on: several buffers of a batch are held at once, and the default of 64 MB can fill a small executor."""
    key, most = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
    if not spark.conf.get(key).lower().rstrip("b").isdigit() or int(spark.conf.get(key).lower().rstrip("b")) > most:
        spark.conf.set(key, f"{most}b")


def unused(df: DataFrame, name: str) -> str:
    """name, or name with underscores, as no column of df is called (Spark does not tell cases apart)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def digest128(text: Column) -> Column:
    """128 bits of xxhash64 under two salts, as 32 hex digits; for grouping equal strings by a short key."""
    half = lambda *c: F.lpad(F.lower(F.hex(F.xxhash64(*c))), 16, "0")
    return F.concat(half(text), half(F.lit("keepsake"), text, F.octet_length(text)))


def text_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array, as views without a copy; a null is an empty slice."""
    import pyarrow as pa

    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    n = len(texts)
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch, column: int, most: int = 1 << 19):
    """The batch in runs of rows whose texts have about `most` bytes together, one row at least: numpy holds some 64 bytes for each byte of text."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, z in zip(cuts, cuts[1:]):
        yield batch.slice(a, z - a)


def runs(batches, keys: int):
    """Rows that come sorted by the first `keys` columns, as one Arrow table for each run of equal values there."""
    import pyarrow as pa

    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.zeros(b.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in columns)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, z - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)
    released()


def released() -> None:
    """Give memory that Arrow and the C library hold for later use back: a worker lives on through many stages of other needs."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; others have none
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (multiply and shift, three rounds)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


_BASE, _POWERS, _INVERSES = 0x9E3779B97F4A7C15 | 1, [np.ones(1, np.uint64)], [np.ones(1, np.uint64)]


def _powers(base: int, n: int, kept: list) -> np.ndarray:
    if len(kept[0]) < n:
        size = max(n, 2 * len(kept[0]))
        with np.errstate(over="ignore"):
            kept[0] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, base, np.uint64), dtype=np.uint64)])
    return kept[0][:n]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of raw[start:end] for every span at once: differences of one prefix sum of b[i] * B**i, shifted to the front by the inverse of B**start."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(raw), _POWERS), out=sums[1:])
        front = _powers(pow(_BASE, -1, 1 << 64), len(raw) + 1, _INVERSES)
        return mix((sums[ends] - sums[starts]) * front[starts] + (ends - starts).astype(np.uint64))


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of all texts in the buffer, and where each text's words begin and end in those lists."""
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.ones(len(raw) + 1, bool)  # no word runs over the end of its text
    inside = ~blank
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    edge[1:-1] = blank[:-1] if len(raw) else edge[1:-1]
    begins = np.flatnonzero(inside & (edge[:-1] | cut[:-1])) if len(raw) else np.zeros(0, np.int64)
    after = np.ones(len(raw), bool)
    after[:-1] = blank[1:] | cut[1:-1] if len(raw) > 1 else after[:-1]
    ends = np.flatnonzero(inside & after) + 1 if len(raw) else np.zeros(0, np.int64)
    return begins, ends, np.searchsorted(begins, offsets)


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
