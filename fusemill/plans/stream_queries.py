"""Streaming queries over ``events``: what a stream run over the whole table has emitted. Windows and sessions that the watermark (two hours behind
the latest event) hasn't passed are still open, in the SQL as well."""

from __future__ import annotations

from pyspark.sql import functions as F

from fusemill.registry import register
from fusemill.sources.tables import table
from fusemill.streaming import arrivals, events, retries

_CLOSED = "(SELECT max(ts) - INTERVAL '2 hours' FROM events)"


def _stream(spark, sf_dir):
    return events.read(spark, f"{sf_dir}/events.parquet")


@register(
    "stream_tumbling",
    f"SELECT * FROM (SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2) WHERE hour + INTERVAL '1 hour' <= {_CLOSED}",
)
def stream_tumbling(spark, sf_dir):
    return events.run_available(events.tumbling(_stream(spark, sf_dir)), "tumbling")


@register(
    "stream_sessions",
    f"""SELECT user_id, min(ts) AS started, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events) x) y
GROUP BY user_id, s HAVING max(ts) + INTERVAL '30 minutes' <= {_CLOSED}""",
)
def stream_sessions(spark, sf_dir):
    return events.run_available(events.sessions(_stream(spark, sf_dir)), "sessions")


@register("stream_once", "SELECT DISTINCT event_id FROM events")
def stream_once(spark, sf_dir):
    return events.run_available(events.once(_stream(spark, sf_dir), ["event_id"]).select("event_id"), "once")


@register(
    "stream_sliding",
    f"""SELECT s AS start, s + INTERVAL '1 hour' AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM (
SELECT time_bucket(INTERVAL '30 minutes', ts) - k * INTERVAL '30 minutes' AS s, event_type, value FROM events, (VALUES (0), (1)) v(k)) x GROUP BY 1, 2, 3 HAVING s + INTERVAL '1 hour' <= {_CLOSED}""",
)
def stream_sliding(spark, sf_dir):
    return events.run_available(events.sliding(_stream(spark, sf_dir)), "sliding")


# an event is delivered ten minutes times its k after it happened; deliveries are of five days
_ARRIVED = "(epoch_us(ts) + CAST(json_extract(props, '$.k') AS BIGINT) * 600000000)"


@register(
    "stream_late_rows",
    f"""WITH a AS (SELECT event_id, ts, {_ARRIVED} // (5 * 86400000000) AS d FROM events), m AS (SELECT d, max(ts) AS latest FROM a GROUP BY d),
w AS (SELECT d, max(latest) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM m)
SELECT event_id, coalesce(a.ts < w.latest - INTERVAL '2 hours', false) AS late FROM a JOIN w ON a.d = w.d""",
)
def stream_late_rows(spark, sf_dir):
    """Every event of the delayed deliveries, on time or late."""
    base = arrivals.new_folder(spark, "late")
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "props")
    arrived = F.unix_micros("ts") + F.from_json("props", "k BIGINT")["k"] * 600_000_000
    arrivals.deliver(e, F.floor(arrived / (5 * 86_400_000_000)), f"{base}/in")
    return arrivals.split_late(arrivals.read(spark, f"{base}/in", e.schema), base).select("event_id", "late")


@register("stream_resume", "SELECT event_id, user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = e.event_id AND o.o_orderstatus = 'F')")
def stream_resume(spark, sf_dir):
    """Events that no finished order has taken up yet."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id"))
    return events.run_available(arrivals.pending(_stream(spark, sf_dir).select("event_id", "user_id"), done, ["event_id"]), "resume")


#: A user's errors are failed attempts, everything else succeeds; three failures give up, twelve hours without an attempt time out.
RETRIES_SQL = f"""WITH a AS (SELECT user_id, ts, event_id, event_type = 'error' AS failed, lag(event_type = 'error') OVER u AS failed_before, ts - lag(ts) OVER u AS gap FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT *, sum(CASE WHEN failed_before AND gap <= INTERVAL '12 hours' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS chain FROM a),
p AS (SELECT *, (row_number() OVER (PARTITION BY user_id, chain ORDER BY ts, event_id) - 1) // 3 AS part FROM c),
e AS (SELECT user_id, chain, part, count(*) AS attempts, bool_and(failed) AS lost, max(ts) AS last FROM p GROUP BY 1, 2, 3)
SELECT user_id::VARCHAR AS key, row_number() OVER (PARTITION BY user_id ORDER BY chain, part) - 1 AS episode, attempts::INTEGER AS attempts, CASE WHEN NOT lost THEN 'resolved' WHEN attempts = 3 THEN 'gave_up' ELSE 'timed_out' END AS state,
  CASE WHEN lost AND attempts < 3 THEN last + INTERVAL '12 hours' ELSE last END AS ended FROM e WHERE NOT lost OR attempts = 3 OR last + INTERVAL '12 hours' <= {_CLOSED}"""


def attempts_of(events_table):
    """Events as attempts: key, ts, failed, tie."""
    return events_table.select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("failed"), F.col("event_id").alias("tie"))


@register("stream_retries", RETRIES_SQL)
def stream_retries(spark, sf_dir):
    return retries.run(retries.episodes(attempts_of(_stream(spark, sf_dir))), arrivals.new_folder(spark, "retries"))
