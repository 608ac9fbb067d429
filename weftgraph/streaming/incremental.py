"""Incremental re-embedding by content hash, and event-time streams (an extension of ours)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.text import fingerprint


def incremental_plan(current: DataFrame, stored: DataFrame, version: str = "1") -> DataFrame:
    """(id, action): new, changed, fresh or deleted, from texts (id, text) and stored hashes (id, hash)."""
    now = current.select("id", fingerprint(version, F.coalesce("text", F.lit(""))).alias("now"))
    both = now.join(stored.select("id", F.col("hash").alias("was")), "id", "full")
    action = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") == F.col("was"), "fresh").otherwise("changed")
    return both.select("id", action.alias("action"))


def changed_files(spark: SparkSession, path: str, schema: str, delay: str = "1 hour") -> DataFrame:
    """Stream of file rows (path, hash, ts), a hash of a path once within the watermark."""
    stream = spark.readStream.schema(schema).parquet(path).withWatermark("ts", delay)
    return stream.dropDuplicatesWithinWatermark(["path", "hash"])


def event_windows(events: DataFrame, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Counts and sums by event-time window and type; late rows beyond the watermark are left out."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    g = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def upsert_batches(stream: DataFrame, path: str, checkpoint: str, key: str = "id", order: str | None = None):
    """Write each micro-batch as the newest version of its keys; batches are replayed to the same folder, so a retry changes nothing.

    Of several rows of a key in a batch, the one with the greatest ``order`` is written; ties, and no order, go by all columns."""

    def write(batch: DataFrame, number: int) -> None:
        row = F.struct(*([order] if order else []), *[c for c in batch.columns if c != order])
        last = batch.groupBy(key).agg(F.max(row).alias("row")).select("row.*").select(*batch.columns)
        last.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """The newest version of each key of ``upsert_batches``."""
    rows = spark.read.parquet(path)
    last = rows.groupBy(key).agg(F.max("batch").alias("batch"))
    return rows.join(last, [key, "batch"])
