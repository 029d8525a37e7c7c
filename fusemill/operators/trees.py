"""Depth and root of every row of a table of parent pointers, by pointer doubling.

A row's pointer leads 1, 2, 4, ... rows up after each round, so a tree of depth d takes log2(d) rounds of one equi-join, however many rows it has. A row on a cycle, or below one, never
reaches a root: once pointers would lead further up than there are rows, what is still open is such a row. Every round's table is written, so that lost executors cost a round at most.

Defined results: a null parent, or one that isn't among the ids, makes a root of depth 0; rows of a cycle and below have null depth and root; of several rows of one id the one of the smallest parent
counts; null ids take no part; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusemill.checkpoint import shared_folder


def _written(df: DataFrame) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/tree-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def depths(rows: DataFrame) -> DataFrame:
    """id, depth and root. rows: id, parent."""
    one = rows.where("id IS NOT NULL").groupBy("id").agg(F.min("parent").alias("parent"))
    known = one.select(F.col("id").alias("up"))
    start = one.withColumnRenamed("parent", "to").join(known, F.col("to") == F.col("up"), "left")
    # up: the row that the pointer has reached; at a root it is null, and root tells which
    now = _written(start.select("id", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.when(F.col("up").isNull(), F.col("id")).alias("root")))
    total, reach = now.count(), 1
    while reach <= total and not now.where("up IS NOT NULL").isEmpty():
        above = now.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("root").alias("found"))
        met = now.where("up IS NOT NULL").join(above, "up")
        moved = met.select("id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("found").alias("root"))
        now = _written(now.where("up IS NULL").unionByName(moved))
        reach *= 2
    closed = F.col("up").isNull()
    return now.select("id", F.when(closed, F.col("depth")).alias("depth"), F.when(closed, F.col("root")).alias("root"))
