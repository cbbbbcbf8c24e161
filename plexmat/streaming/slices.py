"""Time slices from a stream: an extension, batch slices are what the matrix operators need.

Events become counts per tumbling window; a watermark bounds the state, and late events beyond it are dropped by Spark's rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files that arrive in a folder, read as events."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(events: DataFrame, width: str = "7 days", late: str = "1 day") -> DataFrame:
    """(start, cell_id, gene_id, x): counts per window, user and event type."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return (
        timed.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), F.col("user_id").alias("cell_id"), F.col("event_type").alias("gene_id"))
        .agg(F.count("*").cast("double").alias("x"))
        .select(F.col("w.start").alias("start"), "cell_id", "gene_id", "x")
    )


def write_slices(counts: DataFrame, path: str, checkpoint: str):
    """Append finished windows to a table; what is there is taken in one go (call again as files arrive)."""
    return counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
