"""Telemetry as a stream: an extension; the batch replay gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.files import EVENTS


def read(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """Events of new journal files, one per query_id within the watermark."""
    rows = spark.readStream.schema(EVENTS).option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.filter(F.col("_bad").isNull() & F.col("query_id").isNotNull()).drop("_bad")
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["query_id"])


def daily(events: DataFrame) -> DataFrame:
    """Counts and cost by day and path."""
    return events.groupBy(F.window("ts", "1 day"), "path").agg(F.count("*").alias("n"), F.sum("cost_usd").alias("cost_usd"))
