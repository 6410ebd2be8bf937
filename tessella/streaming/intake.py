"""Streams: an extension, as the batch operators over files that arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and key; each event_id once, rows later than ``late`` behind the newest are left out."""
    once = events.withWatermark(time, late).dropDuplicatesWithinWatermark(["event_id"])
    out = once.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "total")


def ingest_available(spark: SparkSession, path: str, schema: T.StructType, store, label: str, key: str, checkpoint: str) -> StreamingQuery:
    """Upserts all files that are there and ends; started again, it takes the new ones alone. Repeated batches change nothing."""
    rows = spark.readStream.schema(schema).parquet(path)

    def write(batch: DataFrame, _: int) -> None:
        store.upsert(batch.where(F.col(key).isNotNull()).select(F.lit(label).alias("label"), F.col(key).cast("string").alias("id"), F.to_json(F.struct("*")).alias("payload")))

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
