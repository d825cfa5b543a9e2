"""Windowed counts of a stream of events, with late data up to a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipworks.session import shared_folder


def windowed(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows; works on a stream and on a table alike."""
    timed = events.where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def drain(spark: SparkSession, source: str, name: str, files_at_once: int = 1000, late: str = "1 day") -> DataFrame:
    """Runs all that a file source holds now through the windows and returns the table that the stream has made.

    Windows are appended to a table in the shared folder once the watermark has passed their end, so those of the last
    ``late`` before the newest event are still open and not in it, and events that come later than that are left out. State is
    kept for open windows only.
    """
    schema = spark.read.parquet(source).schema
    folder, _, file = source.rpartition("/")
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", file).option("maxFilesPerTrigger", files_at_once).parquet(folder)
    windows = windowed(stream, late=late)
    query = windows.writeStream.outputMode("append").format("parquet").option("path", f"{at}/windows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(windows.schema).parquet(f"{at}/windows")
