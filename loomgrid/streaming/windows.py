"""Measures over event streams (beyond what array files offer): the same aggregates, by windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.core.exists import finite, or_nan
from loomgrid.operators.measures import MEASURES


def read_events(spark: SparkSession, directory: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(directory)


def windowed(events: DataFrame, by: list[str], measures: list[str], time: str = "ts", value: str = "value", width: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Measures of each group and window; the watermark bounds the state of a stream, and a batch ignores it."""
    marked = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events
    v = F.col(value).cast("double")
    out = marked.groupBy(F.window(time, width, slide), *by).agg(*(or_nan(MEASURES[m](finite(v), v, F.lit(0.0))).alias(m) for m in measures))
    return out.select(F.col("window.start").alias("start"), *by, *measures)


def sessions(events: DataFrame, by: list[str], gap: str, time: str = "ts", late: str = "1 hour") -> DataFrame:
    marked = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events
    out = marked.groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), *by, "n")
