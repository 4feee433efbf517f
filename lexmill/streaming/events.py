"""Windowed counts over a stream of events, and an index kept up to date by micro-batches (our own extension)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.operators import retrieval


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def tumbling(events: DataFrame, *, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by type and window; rows later than ``late`` are left to the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def maintain_index(docs: DataFrame, tokens: Column, path: str, checkpoint: str, *, id_col: str = "doc_id") -> StreamingQuery:
    """Append each micro-batch's postings in a folder of its batch number, so that a batch redone is written over."""

    def merge(batch: DataFrame, number: int) -> None:
        retrieval.postings(batch, tokens, id_col).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
