"""A keyed store of rows: get, put and get-or-fetch by joins that move nothing of the store.

The store is one table, bucketed by its key and kept in one directory a bucket (column ``slot``, the bucket's own number). Reads join bucket with
bucket, so a request that is bucketed alike needs no exchange and any other request moves only its own rows. A put reads and rewrites the
buckets that its keys fall in (dynamic partition overwrite: files are swapped when the job commits), the others aren't touched.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fusemill.checkpoint import cut, shared_folder
from fusemill.sources import tables

SLOT = "slot"


class Store:
    """Rows of ``columns`` (a DDL string), one for each value of ``key``. Null keys are never stored nor found; an empty store answers nothing."""

    def __init__(self, spark: SparkSession, columns: str, key: str, buckets: int, path: str | None = None, name: str | None = None) -> None:
        """Opens the store at ``path`` (a new one in the shared folder if none is named). ``buckets`` belongs to the files and stays as it was first given."""
        self.spark, self.key, self.buckets = spark, key, buckets
        self.name = name or f"store_{uuid4().hex}"
        self.path = path or f"{shared_folder(spark)}/{self.name}"
        layout = f"PARTITIONED BY ({SLOT}) CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}, {SLOT} INT) USING parquet {layout} LOCATION '{self.path}'")
        spark.table(self.name).limit(0).write.mode("append").partitionBy(SLOT).parquet(self.path)  # makes the folder if it is new
        spark.catalog.recoverPartitions(self.name)

    def slotted(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the bucket of each, without null keys."""
        return rows.where(F.col(self.key).isNotNull()).withColumn(SLOT, F.pmod(F.hash(self.key), F.lit(self.buckets)))

    def rows(self) -> DataFrame:
        return self.spark.table(self.name).drop(SLOT)

    def get(self, wanted: DataFrame) -> DataFrame:
        """The store's rows whose key is among ``wanted``, each once."""
        return self.rows().hint("merge").join(wanted.select(self.key), self.key, "left_semi")

    def misses(self, wanted: DataFrame) -> DataFrame:
        """Rows of ``wanted`` that the store lacks."""
        return wanted.where(F.col(self.key).isNotNull()).hint("merge").join(self.rows().select(self.key), self.key, "left_anti")

    def put(self, rows: DataFrame, order: str | None = None) -> None:
        """Rows replace the stored ones of their keys. Of rows with one key the last in ``order`` counts; without ``order`` keys are unique."""
        new = rows if order is None else tables.keep_last(rows, [self.key], F.col(order))
        fresh = cut(self.slotted(new.select(*self.rows().columns)))  # made once, as it lies: what a fetch gives isn't asked for again
        touched = [r[0] for r in fresh.select(SLOT).distinct().collect()]  # at most one number a bucket
        if not touched:
            return
        there = self.spark.table(self.name).where(F.col(SLOT).isin(touched))
        kept = there.hint("merge").join(fresh.select(self.key), self.key, "left_anti").select(*fresh.columns)
        merged = kept.unionByName(fresh).repartition(self.buckets, self.key)
        mode, before = "spark.sql.sources.partitionOverwriteMode", self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        self.spark.conf.set(mode, "dynamic")  # the only way to ask for it: inserts by name take no options
        try:
            merged.select(*self.spark.table(self.name).columns).write.mode("overwrite").insertInto(self.name)
        finally:
            self.spark.conf.set(mode, before)

    def get_or_fetch(self, wanted: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The rows of all ``wanted`` keys: those missing are fetched, each key once, and stored first. ``fetch`` takes a frame of keys; a key it doesn't answer has no row."""
        self.put(fetch(self.misses(wanted).select(self.key).distinct()))
        return self.get(wanted)
