"""Structured Streaming form of the log analytics; the batch form is the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, delay: str = "1 day", width: str = "7 days", slide: str = "1 day") -> DataFrame:
    """Counts by sliding window and query, late rows dropped after the delay (streams and batches alike)."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", delay)
    return rows.groupBy(F.window("ts", width, slide).alias("w"), "query_normalized").agg(F.count(F.lit(1)).alias("freq")).select(
        F.col("w.start").alias("window_start"), "query_normalized", "freq"
    )


def run_available(spark: SparkSession, source: str, schema, build, sink: str, checkpoint: str) -> DataFrame:
    """Run a stream over the files that are there, append finished windows to a folder, and read them."""
    stream = spark.readStream.schema(schema).parquet(source)
    query = (
        build(stream).writeStream.outputMode("append").format("parquet")
        .option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(sink)
