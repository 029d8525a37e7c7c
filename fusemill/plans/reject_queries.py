"""Events as JSON lines with faults put in, read back: what is kept and what is rejected for which reason."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fusemill.checkpoint import shared_folder
from fusemill.registry import register
from fusemill.sources import rejects
from fusemill.sources.tables import table

SCHEMA = "event_id bigint, user_id bigint, event_type string, value double"


def faulty_lines(events):
    """One line an event: cut off, blank, an array, without its user, or with a word as its value, by its id."""
    e = F.col("event_id")
    whole = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    line = (
        F.when(e % 97 == 0, F.left(whole, F.lit(20)))
        .when(e % 89 == 0, F.lit(" "))
        .when(e % 83 == 0, F.concat(F.lit("["), whole, F.lit("]")))
        .when(e % 79 == 0, F.to_json(F.struct("event_id", "event_type", "value")))
        .when(e % 73 == 0, F.to_json(F.struct("event_id", "user_id", "event_type", F.lit("much").alias("value"))))
    )
    return events.select(F.coalesce(line, whole).alias("line"))


@register(
    "rejected_records",
    """SELECT CASE WHEN event_id % 97 = 0 THEN 'not_json' WHEN event_id % 89 = 0 THEN 'blank' WHEN event_id % 83 = 0 THEN 'not_object' WHEN event_id % 79 = 0 THEN 'missing:user_id' WHEN event_id % 73 = 0 THEN 'type:value' ELSE 'kept' END AS outcome,
count(*) AS n, round(coalesce(sum(CASE WHEN event_id % 97 > 0 AND event_id % 89 > 0 AND event_id % 83 > 0 AND event_id % 79 > 0 AND event_id % 73 > 0 THEN value END), 0), 4) AS total FROM events GROUP BY 1""",
)
def rejected_records(spark, sf_dir):
    """Lines and sums of value by outcome; all lines are in it."""
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    faulty_lines(table(spark, sf_dir, "events")).write.text(path)
    rows, bad = rejects.read(spark, path, SCHEMA, ["event_id", "user_id", "event_type"])
    both = rows.select(F.lit("kept").alias("outcome"), "value").unionByName(bad.select(F.col("reason").alias("outcome"), F.lit(None).cast("double").alias("value")))
    return both.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 4).alias("total"))
