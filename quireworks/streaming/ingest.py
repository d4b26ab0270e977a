"""Streams: a folder that is polled, ingest that is done once for each content, status kept by key, event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def watch_folder(spark: SparkSession, path: str, schema: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def once_by_content(stream: DataFrame, time: str, delay: str, content: str) -> DataFrame:
    """Rows whose content hash was not seen within the delay."""
    return stream.withColumn("content_hash", F.md5(F.col(content).cast("binary"))).withWatermark(time, delay).dropDuplicatesWithinWatermark(["content_hash"])


def event_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", slide: str | None = None, delay: str = "2 hours") -> DataFrame:
    """window_start, key, n, total: tumbling windows, or sliding ones with a slide; late rows within the delay count."""
    span = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, delay).groupBy(span, key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), key, "n", "total")


def session_counts(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("session_start"), key, "n")


def drain(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes all that is there, then ends; a second call goes on where this one stopped."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def latest_status(changes: DataFrame, key: str, time: str) -> DataFrame:
    """The newest row of each key, in batch or, in complete mode, on a stream."""
    fields = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*fields), time).alias("s")).select(key, "s.*")
