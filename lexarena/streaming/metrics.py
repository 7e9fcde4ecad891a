"""Event streams: daily metrics with watermarks, keyed state, and incremental files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_metrics(events: DataFrame, unit: str = "1 day", late: str | None = "2 days") -> DataFrame:
    """(metric_start, event_type, n, total) by tumbling window; works on batches and streams.

    Timestamps without a zone are read as UTC, which a watermark needs.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming and late:
        rows = rows.withWatermark("ts", late)
    grouped = rows.groupBy(F.window("ts", unit).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("metric_start"), "event_type", "n", "total")


def read_stream(spark: SparkSession, folder: str, like: DataFrame, files: int = 1) -> DataFrame:
    """New Parquet files of a folder, a few at a time."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(folder)


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything that is there now through a batch function, once; the checkpoint remembers what was done."""
    query = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def process_new_files(spark: SparkSession, folder: str, schema: str, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """JSON files that earlier runs haven't seen, through a batch function."""
    stream = spark.readStream.schema(schema).option("multiLine", True).json(folder)
    return run_available(stream, handle, checkpoint)


def item_states(events: DataFrame, key: str, order: list[str], status: str) -> DataFrame:
    """(key, status, attempts, updated) of each item in a batch of state events: the last status and the failures before it."""
    last = F.max_by(status, F.struct(*order))
    return events.groupBy(key).agg(last.alias("status"), F.count_if(F.col(status) == "failed").alias("attempts"), F.max(order[0]).alias("updated"))


def retry_delay(attempt: Column, base: float = 2.0, most: float = 10.0) -> Column:
    """Seconds to wait before a retry: linear in the attempts, up to a limit."""
    return F.least(attempt * F.lit(base), F.lit(most))
