"""Incremental ingestion: heads of feeds, work queues, idempotent streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veinwork.functions.dates import backoff_minutes
from veinwork.streaming.sinks import shared_folder


def until_known(df: DataFrame, by: list[str], order: list[Column], known: Column) -> DataFrame:
    """Each feed's rows before its first known one, in order."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_seen", F.max(known.cast("int")).over(w)).filter("_seen = 0").drop("_seen")


def claim(queue: DataFrame, now: Column, batch: int) -> DataFrame:
    """The next ``batch`` rows of a work queue with their place; a top-k, not a sort of the queue."""
    due = (F.col("attempts") == 0) | (F.col("created_at") + F.make_dt_interval(mins=backoff_minutes(F.col("attempts"))) <= now)
    order = [(F.char_length("raw_text") >= 80).desc(), F.col("created_at").desc(), F.col("id")]
    slim = queue.filter(F.col("processed_at").isNull() & due).withColumn("attempts", F.col("attempts") + 1)
    top = slim.orderBy(*order).limit(batch)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


def deduplicated_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counts by type of a feed whose files all arrive twice, in two runs over one checkpoint: each event counts once.

    What a batch keeps is written under its number, so a batch that runs again replaces itself.
    """
    folder, events = shared_folder(spark, "feed"), spark.read.parquet(path)
    for run in ("first", "second"):
        events.write.parquet(f"{folder}/in/{run}")
        feed = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        kept = feed.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["event_id"])
        write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        kept.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/cursor").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    return out.groupBy("event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("worth"))
