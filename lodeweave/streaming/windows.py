"""Streaming forms: tumbling windows with a watermark, and ingest of new files once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def event_counts(events: DataFrame, *, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(event_type, start, n, total) per tumbling window; on a stream rows later than `late` are dropped and windows close once."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select("event_type", F.col("w.start").alias("start"), "n", "total")


def ingest(spark: SparkSession, source: str, schema: StructType | str, target: str, state: str, *, transform=None) -> None:
    """Append what is new under `source` (parquet) to `target`, each file once over all calls: `state` remembers them."""
    rows = spark.readStream.schema(schema).parquet(source)
    out = transform(rows) if transform else rows
    out.writeStream.format("parquet").option("path", target).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
