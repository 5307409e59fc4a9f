"""Streams of an archive: windows under a watermark, micro-batches into a table, stages that resume, stamps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import fresh


def streamed(spark: SparkSession, rows: DataFrame, time: str, query: Callable[[DataFrame], DataFrame], parts: int = 4) -> DataFrame:
    """The complete result of a streaming query over rows, delivered in `parts` files in order of time, one file a micro-batch. The source takes files by the time when they were written, so they are written one after another. time becomes a timestamp of the session's zone; the result is written by foreachBatch, so it survives the stream."""
    source, sink = fresh(spark, "feed"), fresh(spark, "result")
    zoned = rows.withColumn(time, F.col(time).cast("timestamp"))
    at = F.unix_micros(time)
    edges = zoned.select(at.alias("at")).approxQuantile("at", [k / parts for k in range(1, parts)], 0.01) or [0]
    for k in range(len(edges) + 1):
        low = at >= F.lit(int(edges[k - 1])) if k else F.lit(True)
        high = at < F.lit(int(edges[k])) if k < len(edges) else F.lit(True)
        zoned.filter(low & high if k else F.coalesce(high, F.lit(True))).coalesce(1).write.parquet(f"{source}/part={k}")
    stream = spark.readStream.schema(zoned.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
    write = lambda batch, _: batch.write.mode("overwrite").parquet(sink)
    run = query(stream).writeStream.outputMode("complete").option("checkpointLocation", fresh(spark, "stream")).foreachBatch(write).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(sink)


def replayed(spark: SparkSession, parts: Sequence[DataFrame], merge: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """The table after each delivery was merged into it by a stream. A batch that comes again finds its own version of the table and changes nothing."""
    source, table = fresh(spark, "feed"), fresh(spark, "table")
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{source}/part={k}")
    schema = parts[0].schema

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.select(*schema.names)
        held = spark.read.schema(schema).parquet(f"{table}/v{number - 1}") if number else batch.limit(0)
        merge(held, batch).write.mode("overwrite").parquet(f"{table}/v{number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
    run = stream.writeStream.option("checkpointLocation", fresh(spark, "stream")).foreachBatch(write).trigger(availableNow=True).start()
    run.awaitTermination()
    last = max(int(p["batchId"]) for p in run.recentProgress if p["numInputRows"] > 0)
    return spark.read.parquet(f"{table}/v{last}")


def resumed(spark: SparkSession, state: str, stages: Sequence[tuple[str, Callable[[], None]]]) -> None:
    """Do the stages in turn; those that an earlier run has noted as done are passed over. A stage is noted once it has ended."""
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(state).getFileSystem(spark._jsc.hadoopConfiguration())
    for name, work in stages:
        if not fs.exists(jvm.Path(f"{state}/{name}")):
            work()
            spark.range(0).write.mode("overwrite").parquet(f"{state}/{name}")


def stamp(log: DataFrame, key: str) -> tuple:
    """What a log is known by: how many rows it has, and its largest key."""
    return tuple(log.agg(F.count("*"), F.max(key)).first())


def fresher(log: DataFrame, key: str, held: tuple, fast: DataFrame, slow: DataFrame) -> DataFrame:
    """The precomputed table while its stamp is the log's, else the one made from the log."""
    return fast if stamp(log, key) == held else slow
