"""Event-time windows, in batch and streaming form, and continuous ingest with deduplication.

The reference system has no event-time operators; these are extensions over an event table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str, ts: str = "ts", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums of fixed windows; works on a stream with a watermark as it does on a table."""
    grouped = events.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, width: str, step: str, ts: str = "ts", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    grouped = events.groupBy(F.window(ts, width, step).alias("w"), *keys).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, gap_seconds: int, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Batch sessions: a new one starts after a silence longer than the gap."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    silence = F.timestamp_diff("MICROSECOND", F.lag(ts).over(w), F.col(ts))
    marked = events.withColumn("fresh", F.coalesce((silence > gap_seconds * 1_000_000).cast("int"), F.lit(1)))
    numbered = marked.withColumn("session", F.sum("fresh").over(w))
    return numbered.groupBy(key, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))


def stream_sessions(stream: DataFrame, gap: str, late: str, key: str = "user_id", ts: str = "ts") -> DataFrame:
    grouped = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_documents(spark: SparkSession, path: str, schema, late: str = "1 day") -> DataFrame:
    """Files of document rows as a stream, content copies within the watermark dropped."""
    rows = spark.readStream.schema(schema).parquet(path)
    keyed = rows.withColumn("content_id", F.substring(F.sha2("text", 256), 1, 16)).withColumn("seen_at", F.current_timestamp())
    return keyed.withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["content_id"])


def ingest_stream(stream: DataFrame, write_batch, checkpoint: str):
    """Start a query that hands every micro-batch to ``write_batch(df, epoch)`` and stops when drained."""
    return stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
