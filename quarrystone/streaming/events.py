"""Extension: Structured Streaming over an append-only event log, with the same plan in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def windowed_totals(events: DataFrame, length: str, late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) of tumbling windows; on a stream, ``late`` is the watermark."""
    source = events.withWatermark("ts", late) if late else events
    out = source.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """(user_id, start, end, n): events of a user without a pause of gap."""
    source = events.withWatermark("ts", late) if late else events
    out = source.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def append_log(events: DataFrame, folder: str, checkpoint: str) -> object:
    """Appends a stream to a Parquet log once for each event file that is there."""
    return events.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
