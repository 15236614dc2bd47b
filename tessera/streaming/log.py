"""Structured Streaming over keyed logs: counters by key, windows, latest edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def log_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files of events as a stream; the time column becomes one with a zone, as watermarks need."""
    stream = spark.readStream.schema(schema).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def upsert_counts(stream: DataFrame, key: str = "event_type") -> DataFrame:
    """Counters by key, for the update or complete output mode."""
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("searches"), F.count_if(F.col("value") < 5).alias("zero"), F.max("ts").alias("last"))


def windowed_counts(stream: DataFrame, late: str = "10 minutes", length: str = "1 hour", key: str = "event_type") -> DataFrame:
    """Counters by key and window; rows later than the watermark are dropped by it."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", length), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v")).select(F.col("window.start").alias("start"), key, "n", "v")


def drain(result: DataFrame, mode: str, folder: str) -> DataFrame:
    """Run a stream over all files there are and return what it wrote below a shared folder: rows as they become final
    (append), or the table of the last batch (complete).  The checkpoint lies beside it, so a broken run goes on."""
    spark, rows = result.sparkSession, f"{folder}/rows"
    writer = result.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", rows)
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(rows))
    writer.start().awaitTermination()
    return spark.read.schema(result.schema).parquet(rows)
