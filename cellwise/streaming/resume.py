"""Resumable appends: new records are taken up as a stream, once each, and the files say where it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cellwise.sources.readers import RECORD


def stream_records(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """Records of a folder that grows, as a stream."""
    return spark.readStream.schema(schema).json(path)


def append_new(stream: DataFrame, out: str, checkpoint: str, key: str, event_time: str | None = None, late: str = "10 minutes") -> StreamingQuery:
    """Appends what has arrived to ``out``, each key once, then stops; the next call goes on from there.

    With ``event_time`` keys are remembered as long as ``late`` says; without, for ever.
    """
    rows = stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark([key]) if event_time else stream.dropDuplicates([key])
    return rows.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, event_time: str, group: str, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events by window and group, with late rows up to ``late``."""
    from pyspark.sql import functions as F

    return stream.withWatermark(event_time, late).groupBy(F.window(event_time, size), group).agg(F.count("*").alias("n"))
