"""Streams of measurement or event files: typed reading, windowed summaries with late data, exactly-once tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def stream_files(spark: SparkSession, folder: str, schema: StructType | str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(folder)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type and window; rows later than `late` are left out of closed windows."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def write_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch into its own folder by number, so that a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
