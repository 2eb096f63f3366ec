"""Conversion as deliveries arrive. Only what is row by row streams; duplicates, components and splits can change in
hindsight, so the merge stays a batch job over the converted table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.adapters import raw_record_rows


def stream_conversion(spark: SparkSession, folder: str, schema, output: str, checkpoint: str, files_per_trigger: int = 64) -> StreamingQuery:
    """Converts Parquet deliveries that arrive in a folder, each exactly once, into a table of decision rows with their
    reasons. Runs until all files there are converted."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    writer = raw_record_rows(raw, need_group=True).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()


def stream_deduplicated(events: DataFrame, time: str, key: str, delay: str) -> DataFrame:
    """Events without redelivered ones; a key is remembered until the watermark has passed it."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str, delay: str, width: str, by: str) -> DataFrame:
    """Counts by window and key; late events within the delay still count."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n"))
