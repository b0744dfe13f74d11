"""Streaming forms: scans need no state; latest choices keep one row a key inside a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.operators import detect, readability
from quillspark.plans.rules import Rule


def read_documents(spark, path: str, schema: StructType | str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def scan_stream(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """Violations and readability of arriving documents; append mode, no state."""
    return readability.measure(detect.scan(docs, text_col, rules), text_col)


def windowed_counts(events: DataFrame, at: str, kind: str, late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """Events by window and kind; rows later than ``late`` are dropped with their windows closed."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("window"), kind).agg(F.count("*").alias("n"))


def first_choices(preferences: DataFrame, at: str, late: str = "1 day") -> DataFrame:
    """One row a pair inside the watermark (replayed rounds count once)."""
    return preferences.withWatermark(at, late).dropDuplicatesWithinWatermark(["pair_id"])


def write(stream: DataFrame, path: str, checkpoint: str):
    """Exactly-once Parquet sink."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
