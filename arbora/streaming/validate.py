"""Validation of streams of notifications: row-local checks need no state; keys keep state up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.operators.navigation import entry_path
from arbora.operators.validation import row_checks
from arbora.plans.model import Node


def read_notifications(spark, path: str, schema, max_files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def validate_stream(stream: DataFrame, node: Node) -> DataFrame:
    """Row-local violations of a stream; the same plan as for a table."""
    return row_checks(stream, node, entry_path(node.name, list(node.keys)), f"/{node.name}")


def first_of_key(stream: DataFrame, keys: list[str], event_time: str, delay: str = "10 minutes") -> DataFrame:
    """The first event of each key; later ones within the watermark are repeats."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def counts(stream: DataFrame, event_time: str, window: str, delay: str, *keys: str) -> DataFrame:
    """Instances per window and key, late ones up to the watermark included."""
    timed = stream.withWatermark(event_time, delay)
    return timed.groupBy(F.window(event_time, window), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")
