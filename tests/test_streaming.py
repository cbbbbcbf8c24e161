from pyspark.sql import functions as F

from plexmat.streaming import slices


def test_stream_and_batch_agree_on_finished_windows(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source = str(tmp_path / "in")
    events.coalesce(1).write.parquet(source)
    out = str(tmp_path / "out")
    slices.write_slices(slices.windowed_counts(slices.event_stream(spark, source), "7 days", "0 seconds"), out, str(tmp_path / "check")).awaitTermination()
    late = events.limit(1).withColumn("ts", F.lit("2099-01-01").cast("timestamp"))  # moves the watermark past all windows
    late.write.mode("append").parquet(source)
    slices.write_slices(slices.windowed_counts(slices.event_stream(spark, source), "7 days", "0 seconds"), out, str(tmp_path / "check")).awaitTermination()
    batch = events.groupBy(F.window("ts", "7 days").alias("w"), "user_id", "event_type").count().select(F.col("w.start").alias("start"), F.col("user_id").alias("cell_id"), F.col("event_type").alias("gene_id"), F.col("count").cast("double").alias("x"))
    assert sorted(spark.read.parquet(out).collect()) == sorted(batch.collect())
