"""Streams: counted events in event-time windows, and an accumulating upsert of counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.jobs.scratch import stored

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """The event files of a folder as a stream; new files of that name pattern are read as they come."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", name).option("recursiveFileLookup", "true").parquet(folder)


def windowed(stream: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by window and type; rows later than the watermark no longer count."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def run_upserts(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Drain the stream: each micro-batch writes its own partial counts under its number, so that a
    batch that is run again replaces itself; the sums over all batches are the table."""
    spark = stream.sparkSession
    marker = stored(spark.range(1), "stream")
    base = marker.inputFiles()[0].rsplit("/", 2)[0] + f"/upserts-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/rows").groupBy(*keys).agg(F.sum("count").alias("count"))
