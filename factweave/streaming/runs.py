"""Streams: periodic statistics of a run log, and analysis of source files as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pulses(log: DataFrame, width: str = "5 seconds", late: str = "10 seconds") -> DataFrame:
    """(start, kind, n, best) for each window of a log (ts, kind, value), batch or stream; streams drop later rows."""
    marked = log.withWatermark("ts", late) if log.isStreaming else log
    return marked.groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count("*").alias("n"), F.max("value").alias("best")).select(F.col("w.start").alias("start"), "kind", "n", "best")


def follow(spark: SparkSession, path: str, schema: str, checkpoint: str, sink: Callable[[DataFrame, int], None], once: bool = True):
    """Hand new Parquet files of a folder to ``sink`` in batches; the checkpoint keeps what was seen, so each file is
    handed over once even after a restart."""
    stream = spark.readStream.schema(schema).parquet(path)
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def ingest(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str, key: list[str], ts: str | None = None, late: str = "1 hour") -> None:
    """Take all files of a folder that are new since the last run into the Parquet table ``out``, each key once.

    The checkpoint holds which files were read and which keys were seen, so runs may stop and start again; with an event
    time column ``ts`` keys are only remembered for as long as ``late``, else for ever.
    """
    rows = spark.readStream.schema(schema).parquet(path)
    once = rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(key) if ts else rows.dropDuplicates(key)
    once.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
