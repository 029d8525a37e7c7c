"""JSON lines with a channel for what can't be read: every line becomes a row or a reject of (file, line, reason), none is lost.

Lines are numbered within their file, so a file is read as one text: have shards of a bounded size written (``tables.shard_numbers``). Everything else is column expressions: a line is parsed once,
as a variant, and its fields are taken with their types.

Defined results: reasons are blank, not_json, not_object, missing:<field> (absent or null) and type:<field>, the first field in the schema's order; a field that isn't required may be absent or null, but not of
another type; further fields are dropped; a file's last line feed ends its last line and makes no line of its own; an empty file has no lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1) and text."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"\r?\n\z", "").alias("value"), (F.length("value") > 0).alias("any"))
    each = whole.where("any").select("file", F.posexplode(F.split("value", r"\r?\n")).alias("at", "text"))
    return each.select("file", (F.col("at") + 1).cast("long").alias("line"), "text")


def _reason(schema: StructType, required: Sequence[str]) -> Column:
    v = F.col("v")
    out = F.when(F.trim(F.regexp_replace("text", r"\s", " ")) == "", "blank").when(v.isNull(), "not_json").when(~F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), "not_object")
    for f in schema.fields:
        there = F.try_variant_get(v, f"$.{f.name}", "variant")
        absent = there.isNull() | F.is_variant_null(there)
        if f.name in required:
            out = out.when(absent, f"missing:{f.name}")
        out = out.when(~absent & F.try_variant_get(v, f"$.{f.name}", f.dataType.simpleString()).isNull(), f"type:{f.name}")
    return out


def read(spark: SparkSession, path: str, schema: StructType | str, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (file, line and the fields of ``schema``) and rejects (file, line, reason) of all lines below ``path``."""
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    parsed = lines(spark, path).withColumn("v", F.try_parse_json("text"))
    judged = parsed.withColumn("reason", _reason(wanted, required))
    fields = [F.try_variant_get("v", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in wanted.fields]
    rows = judged.where("reason IS NULL").select("file", "line", *fields)
    return rows, judged.where("reason IS NOT NULL").select("file", "line", "reason")
