"""Sources and sinks: Parquet, JSON lines, keyed upserts, sharded writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_json_records(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """``.jsonl`` line by line (malformed lines skipped), ``.json`` as a list or under ``data``; other suffixes fail."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if path.endswith(".jsonl"):
        return reader.option("mode", "DROPMALFORMED").json(path)
    if not path.endswith(".json"):
        raise ValueError(f"neither .json nor .jsonl: {path}")
    df = spark.read.option("multiLine", True).json(path)
    return df.select(F.explode("data").alias("r")).select("r.*") if df.columns == ["data"] else df


def distinct_ids(df: DataFrame, column: str = "question_id") -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def keep_first(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The first row of each key in ``order``."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def keep_last(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    return keep_first(df, keys, order.desc())


def upsert(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``base`` with the same keys."""
    return base.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def missing(wanted: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``wanted`` whose keys aren't ``there`` yet: what a resumed run has to do."""
    return wanted.join(there.select(*keys).distinct(), keys, "left_anti")


def shard_numbers(df: DataFrame, size: Column, partition: str, order: list[str], max_bytes: int, max_rows: int) -> DataFrame:
    """Add shard (from 0): consecutive rows of a partition by running bytes and rows."""
    w = Window.partitionBy(partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before, n = F.coalesce(F.sum(size).over(w), F.lit(0)), F.count(F.lit(1)).over(w)
    return df.withColumn("shard", F.greatest(F.floor(before / max_bytes), F.floor(n / max_rows)).cast("int"))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
