"""Interval and nearest-point joins: sessions, the events of other users within them, and nearest orders; curve values at the nearest grid point."""

from __future__ import annotations

from pyspark.sql import functions as F

from fusemill.operators import curves, intervals
from fusemill.registry import register
from fusemill.sources.tables import table

_SESSIONS = """SELECT user_id, min(ts) AS started, max(ts) AS ended FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM events) x) y GROUP BY user_id, s"""


def sessions(spark, sf_dir):
    """user_id, started, ended (first and last event), start and end in microseconds: a gap of six hours ends a session."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = e.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("own"))
    return s.select("user_id", "started", "ended", "own", F.unix_micros("started").alias("start"), F.unix_micros("ended").alias("end"))


@register("events_in_sessions", f"WITH s AS ({_SESSIONS}) SELECT s.user_id, started, count(*) AS n, min(e.event_id) AS first_event FROM s JOIN events e ON e.ts BETWEEN started AND ended AND e.user_id <> s.user_id GROUP BY 1, 2")
def events_in_sessions(spark, sf_dir):
    """Events of other users within each session."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    met = intervals.others_within(e, sessions(spark, sf_dir).withColumnRenamed("user_id", "key"))
    return met.select(F.col("key").alias("user_id"), F.timestamp_micros("start").alias("started"), "n", F.col("first_id").alias("first_event"))


@register("session_overlaps", f"WITH s AS ({_SESSIONS}) SELECT a.user_id, count(*) AS n, count(DISTINCT b.user_id) AS users FROM s a JOIN s b ON a.started <= b.ended AND b.started <= a.ended AND a.user_id <> b.user_id GROUP BY 1")
def session_overlaps(spark, sf_dir):
    """With how many sessions of others, and of how many others, a user's sessions overlap."""
    met = intervals.overlap_counts(sessions(spark, sf_dir).withColumnRenamed("user_id", "key"))
    return met.select(F.col("key").alias("user_id"), "n", F.col("keys").alias("users"))


@register("nearest_order", "SELECT event_id, min(abs(epoch_us(o_orderdate) - epoch_us(ts))) AS gap FROM events LEFT JOIN orders ON o_custkey = user_id GROUP BY 1")
def nearest_order(spark, sf_dir):
    """Microseconds between each event and its user's nearest order, before or after."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at"))
    return intervals.nearest(e, o, "user_id").select("event_id", F.abs(F.col("near") - F.col("at")).alias("gap"))


@register(
    "nearest_grid_value",
    """WITH p AS (SELECT p_partkey, p_size, (p_partkey * 37 % 101) / 100.0::DOUBLE AS w FROM part), g AS (SELECT p_partkey, w, i, (i / 10.0)::DOUBLE AS x, (p_size * (i + 3) % 11) / 10.0::DOUBLE AS y FROM p, range(11) r(i))
SELECT p_partkey, y AS value FROM g QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY round(abs(x - w), 9), i) = 1""",
)
def nearest_grid_value(spark, sf_dir):
    """A part's curve, read at the grid point nearest to its weight."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_partkey") * 37 % 101 / 100).alias("w"))
    curve = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: (F.col("p_size") * (i + 3) % 11) / 10)
    # hundredths, so that equal gaps are equal
    grid = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: (i * 10).cast("double"))
    return p.select("p_partkey", curves.nearest_value(curve, grid, F.round(F.col("w") * 100)).alias("value"))
