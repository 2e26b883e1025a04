"""Structured Streaming extension: verdicts and events as they arrive.

The reference data model only knows append-only logs that are resumed by key; these operators do the
same on streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def verdict_stream(spark: SparkSession, folder: str, watermark: str = "1 day") -> DataFrame:
    """Verdict JSON lines of a folder, each cluster once within the watermark; a stored error counts as
    done and is not judged again."""
    schema = "cluster_id string, target string, verdict string, confidence double, judged_at timestamp"
    return spark.readStream.schema(schema).json(folder).where("cluster_id is not null").withWatermark("judged_at", watermark).dropDuplicatesWithinWatermark(["cluster_id"])


def windowed_events(events: DataFrame, window: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """Events per type and tumbling window; works on streams and on tables."""
    e = events.withWatermark("ts", watermark) if events.isStreaming else events
    return e.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and gives its result as a table held in memory; for tests
    and small inputs."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
