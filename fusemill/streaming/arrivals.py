"""Streams whose files arrive one delivery after another: rows too late for the watermark kept aside, and resuming against what is done.

Spark drops rows behind the watermark without a trace. ``split_late`` decides before any window does, by the same rule (a row is late if its time is below the greatest time of earlier
batches less ``delay``), and writes both kinds, so that on-time and late rows together are all rows. A batch's watermark is read from the batch before, and a batch that is run again after a failure
overwrites its own files, so nothing is counted twice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fusemill.checkpoint import shared_folder


def deliver(rows: DataFrame, delivery: Column, folder: str, files: int = 2) -> list[int]:
    """Write ``rows`` as one delivery after another, ``files`` files each, in the order of the small whole number ``delivery``; returns the deliveries written."""
    numbered = rows.withColumn("_delivery", delivery.cast("int"))
    wanted = sorted(r[0] for r in numbered.select("_delivery").distinct().collect())
    for k in wanted:
        numbered.where(F.col("_delivery") == k).drop("_delivery").repartition(files).write.mode("append").parquet(folder)
    return wanted


def read(spark: SparkSession, folder: str, schema, files: int = 2) -> DataFrame:
    """Deliveries of ``folder`` as a stream, one a batch, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def split_late(stream: DataFrame, base: str, time: str = "ts", delay: str = "2 hours") -> DataFrame:
    """Run the stream over all there is; every row comes back with batch and late."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = session.read.parquet(f"{base}/progress/batch={number - 1}").first()["latest"] if number else None
        mark = F.lit(before).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        late = F.coalesce(F.col(time) < mark, F.lit(False))
        batch.withColumn("late", late).write.mode("overwrite").parquet(f"{base}/rows/batch={number}")
        latest = session.read.parquet(f"{base}/rows/batch={number}").agg(F.greatest(F.max(time), F.lit(before).cast("timestamp")).alias("latest"))
        latest.write.mode("overwrite").parquet(f"{base}/progress/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/rows")


def pending(stream: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the stream that aren't done yet: an anti-join with a table that is read anew in every batch."""
    return stream.join(done.select(*keys), keys, "left_anti")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
