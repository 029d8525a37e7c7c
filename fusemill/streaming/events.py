"""Event streams: windows, sessions and deduplication with watermarks, and runs over what is there now.

State is bounded by the watermark: a window or session is emitted once when the watermark passes its end, an id is remembered for ``delay``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fusemill.checkpoint import shared_folder


def read(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet folder or file ``path`` as a stream, with ts as a timestamp."""
    glob = f"{path[:-1]}[{path[-1]}]"  # a stream takes one file only by a pattern
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(glob).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("hour"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """Overlapping windows: each event counts in width / step of them."""
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", width, step), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    s = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("started"), "n")


def once(events: DataFrame, keys: list[str], delay: str = "2 hours") -> DataFrame:
    """The first row of each key; a key is forgotten ``delay`` after its time, so memory doesn't grow with the stream."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Run the stream over all there is now; its appended rows come back as a table in the shared checkpoint folder."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
