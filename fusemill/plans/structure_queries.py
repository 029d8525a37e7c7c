"""Trees of parent pointers, and runs by a table function in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from fusemill.operators import runs, trees
from fusemill.registry import register
from fusemill.sources.tables import table

_NODES = """SELECT 'region ' || r_regionkey AS id, NULL::VARCHAR AS parent FROM region UNION ALL SELECT 'nation ' || n_nationkey, 'region ' || n_regionkey FROM nation UNION ALL
SELECT 'supplier ' || s_suppkey, 'nation ' || s_nationkey FROM supplier UNION ALL SELECT 'customer ' || c_custkey, 'nation ' || c_nationkey FROM customer UNION ALL
SELECT 'order ' || o_orderkey, 'customer ' || o_custkey FROM orders"""
_DEPTHS = "t(id, depth, root) AS (SELECT id, 0::BIGINT, id FROM n WHERE parent IS NULL OR parent NOT IN (SELECT id FROM n) UNION ALL SELECT n.id, depth + 1, root FROM n JOIN t ON n.parent = t.id)"


@register("containment_depths", f"WITH RECURSIVE n AS ({_NODES}), {_DEPTHS} SELECT id, depth, root FROM t")
def containment_depths(spark, sf_dir):
    """Depth and root of everything between regions and orders."""
    links = [("region", "r_regionkey", None, None), ("nation", "n_nationkey", "region", "n_regionkey"), ("supplier", "s_suppkey", "nation", "s_nationkey"), ("customer", "c_custkey", "nation", "c_nationkey"), ("orders", "o_orderkey", "customer", "o_custkey")]
    name = lambda kind, key: F.concat(F.lit(f"{kind} "), F.col(key).cast("string")) if kind else F.lit(None).cast("string")
    each = [table(spark, sf_dir, t).select(name(t.removesuffix("s"), key).alias("id"), name(up, parent).alias("parent")) for t, key, up, parent in links]
    return trees.depths(reduce(lambda a, b: a.unionByName(b), each))


@register(
    "reply_depths",
    """WITH RECURSIVE p AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS above FROM (SELECT DISTINCT conv_id, turn FROM conversations)),
t(conv_id, turn, depth) AS (SELECT conv_id, turn, 0::BIGINT FROM p WHERE above IS NULL UNION ALL SELECT p.conv_id, p.turn, depth + 1 FROM p JOIN t ON p.conv_id = t.conv_id AND p.above = t.turn) SELECT conv_id, turn, depth FROM t""",
)
def reply_depths(spark, sf_dir):
    """How many turns each turn of a conversation replies to, one after the other."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    here = F.struct("conv_id", "turn")
    turns = t.groupBy("conv_id").agg(F.sort_array(F.collect_set("turn")).alias("turns")).select("conv_id", F.posexplode("turns").alias("k", "turn"), "turns")
    above = F.when(F.col("k") > 0, F.struct("conv_id", F.get("turns", F.col("k") - 1).alias("turn")))
    return trees.depths(turns.select(here.alias("id"), above.alias("parent"))).select("id.conv_id", "id.turn", "depth")


@register(
    "event_runs",
    """WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events)
SELECT user_id AS key, event_type AS value, count(*) AS n, min(ts) AS first, max(ts) AS last FROM a GROUP BY user_id, event_type, g""",
)
def event_runs(spark, sf_dir):
    """Runs of one type among a user's events."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("ts").cast("timestamp").alias("at"), "event_id")
    return spark.sql(f"SELECT * FROM {runs.register(spark)}(TABLE(SELECT * FROM {{e}}) PARTITION BY key ORDER BY (at, event_id))", e=e)
