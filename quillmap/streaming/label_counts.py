"""Counts by label over a stream of studies: an extension, as the aggregates of decoding are algebraic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def label_counts(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window, label, n, total) of a stream (ts, label, value); events later than the watermark are dropped. Runs on a static table as well."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("window"), "label").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def from_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
