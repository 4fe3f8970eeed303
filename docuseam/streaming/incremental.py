"""Streams: event windows with late data, and incremental enrichment of new rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and value per window and type; works on batches and streams."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("at", late)
    out = rows.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("at", late)
    out = rows.groupBy(F.session_window("at", gap).alias("s"), "user_id").agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("s.start").cast("timestamp_ntz").alias("session_start"), F.col("s.end").cast("timestamp_ntz").alias("session_end"), "events")


def enrich_new(spark: SparkSession, source: str, schema, target: str, state: str, key: str, enrich: Callable[[DataFrame], DataFrame], files: int = 100) -> StreamingQuery:
    """Enrich files as they come; rows whose key the target has already are skipped.

    A batch that is run again after a lost executor or driver finds its rows
    done, so each row is appended once.
    """

    def append(batch: DataFrame, _: int) -> None:
        batch = batch.dropDuplicates([key])
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            batch = batch.join(spark.read.parquet(target).select(key), key, "left_anti")
        enrich(batch).write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return stream.writeStream.foreachBatch(append).option("checkpointLocation", state).trigger(availableNow=True).start()
