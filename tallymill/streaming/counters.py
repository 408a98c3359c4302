"""Running counters over event files: an extension that keeps the status histograms of a log up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

WINDOW, LATENESS = "1 hour", "2 hours"


def event_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 8) -> DataFrame:
    """New event files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def counts(events: DataFrame) -> DataFrame:
    """(start, event_type, n, total) by hour. Events later than the watermark are dropped by Spark; null types count as unknown. Works on streams and tables alike."""
    kind = F.coalesce("event_type", F.lit("unknown")).alias("event_type")
    by = events.withWatermark("ts", LATENESS).groupBy(F.window("ts", WINDOW), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def maintain(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Takes in all files there are now and appends the hours that are complete to the target; runs again from where it stopped."""
    counts(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
