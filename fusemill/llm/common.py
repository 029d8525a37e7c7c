"""What the operators of this subpackage share: reading tables, carrying rows whole and cutting lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fusemill.checkpoint import cut, shared_folder  # noqa: F401  (the operators take both from here)

#: White space as the contracts define it, for use inside a character class.
ASCII_SPACE = r"\x20\x09-\x0D"
#: The column that carries an input row whole, so that no working column can clash with the row's own.
ROW = "row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` as Parquet files in the shared folder, read again: smaller than a checkpoint, and read by columns."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def named(column: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def boxed(docs: DataFrame) -> Column:
    """A row's columns as one struct under the name ROW."""
    return F.struct(*[named(c).alias(c) for c in docs.columns]).alias(ROW)


def unboxed(df: DataFrame, columns: list[str], **made: Column) -> DataFrame:
    """The boxed ``columns`` and the ``made`` ones; a made column stands in the place of one of its name, any case."""
    left = {k.lower(): (k, c) for k, c in made.items()}
    out = []
    for c in columns:
        key, new = left.pop(c.lower(), (c, F.col(ROW).getField(c)))
        out.append(new.alias(key))
    return df.select(*out, *[c.alias(k) for k, c in left.values()])


def words_of(text: Column, separators: str) -> Column:
    """Non-empty pieces of ``text`` between runs of ``separators`` (the inside of a character class)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{separators}]+"), "")


def row_hash(docs: DataFrame) -> Column:
    """A hash of everything a row holds: tells rows of one id apart, whatever their columns are."""
    hashable = lambda c: "map<" not in docs.schema[c].dataType.simpleString() and "variant" not in docs.schema[c].dataType.simpleString()
    return F.xxhash64(*[named(c) if hashable(c) else F.to_json(F.struct(named(c))) for c in docs.columns])
