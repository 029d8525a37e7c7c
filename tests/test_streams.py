"""Retries over restarts, late rows, and sketches merged over levels against exact values."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from fusemill.operators import sketches
from fusemill.plans.stream_queries import RETRIES_SQL, attempts_of
from fusemill.streaming import arrivals, retries

SMALL = "/root/testdata/sf0.001/events.parquet"


def ran(spark, rows, base, parts):
    """Retries over deliveries, with a restart between the parts."""
    for part in parts:
        arrivals.deliver(rows.where(F.col("part").isin(part)), F.col("part"), f"{base}/in")
        stream = arrivals.read(spark, f"{base}/in", rows.schema)
        out = retries.run(retries.episodes(attempts_of(stream)), base)
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_retries_survive_a_restart(spark):
    e = spark.read.parquet(SMALL).withColumn("part", F.floor(F.col("event_id") / 150).cast("int"))
    want = duckdb.sql(RETRIES_SQL.replace("FROM events", f"FROM '{SMALL}'")).fetchall()
    once = ran(spark, e, arrivals.new_folder(spark, "retries"), [list(range(7))])
    twice = ran(spark, e, arrivals.new_folder(spark, "retries"), [[0, 1, 2], [3, 4], [5, 6]])
    assert once == twice == sorted(want, key=str)
    assert {r[3] for r in once} == {"resolved", "gave_up", "timed_out"}


def test_retry_states_by_hand(spark):
    rows = [("a", 0, "error"), ("a", 1, "error"), ("a", 2, "error"), ("a", 3, "view"), ("b", 0, "error"), ("b", 13, "view"), ("c", 0, "error"), ("c", 12, "view"), ("d", 0, "error"), ("z", 40, "view"), (None, 1, "view")]
    df = spark.createDataFrame([(u, k, t, n) for n, (u, k, t) in enumerate(rows)], "user_id string, k int, event_type string, event_id int")
    df = df.withColumn("ts", F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, k)")).withColumn("part", F.lit(0))
    got = ran(spark, df, arrivals.new_folder(spark, "retries"), [[0]])
    assert [(r[0], r[1], r[2], r[3]) for r in sorted(got, key=str)] == sorted(
        [("a", 0, 3, "gave_up"), ("a", 1, 1, "resolved"), ("b", 0, 1, "timed_out"), ("b", 1, 1, "resolved"), ("c", 0, 2, "resolved"), ("d", 0, 1, "timed_out"), ("z", 0, 1, "resolved"), (None, 0, 1, "resolved")], key=str
    )


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_time_outs_wait_for_the_watermark(spark, tmp_path, zone):
    """a: an attempt shows a time-out that the watermark hasn't passed; b, c: ends at the watermark and a millisecond behind it."""
    rows = [("a", "00:30:00", "error"), ("a", "13:00:00", "view"), ("a", "13:30:00", "error"), ("b", "00:00:00", "error"), ("c", "00:00:00.001", "error"), ("z", "14:00:00", "view")]
    rows = [(u, f"2024-01-01 {t}", k, n) for n, (u, t, k) in enumerate(rows)]
    later = [("z", "2024-01-01 20:00:00", "view", 20)]
    schema = "user_id string, ts string, event_type string, event_id int"
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(*r, p) for p, part in enumerate((rows, later)) for r in part], f"{schema}, part int").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        base = arrivals.new_folder(spark, "retries")
        for k in (0, 1):
            file = str(tmp_path / f"{k}.parquet")
            df.where(F.col("part") <= k).toPandas().to_parquet(file)
            want = sorted(r[:4] for r in duckdb.sql(RETRIES_SQL.replace("FROM events", f"FROM '{file}'")).fetchall())
            assert sorted(r[:4] for r in ran(spark, df, base, [[k]])) == want
            assert [r[1:4] for r in want if r[0] == "a"] == ([(0, 1, "resolved")] if k == 0 else [(0, 1, "timed_out"), (1, 1, "resolved")])
            assert ("b", 0, 1, "timed_out") in want and (("c", 0, 1, "timed_out") in want) == (k == 1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_late_and_timely_rows_are_all_rows(spark):
    base = arrivals.new_folder(spark, "late")
    rows = spark.createDataFrame([(1, 10, 0), (2, 5, 0), (3, 7, 1), (4, 9, 1), (5, 30, 1), (6, 10, 2), (7, None, 2), (8, 28, 2)], "event_id int, h int, part int")
    rows = rows.withColumn("ts", F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, h)"))
    assert arrivals.deliver(rows, F.col("part"), f"{base}/in", 1) == [0, 1, 2]
    out = arrivals.split_late(arrivals.read(spark, f"{base}/in", rows.schema, 1), base)
    assert {r.event_id: (r.batch, r.late) for r in out.collect()} == {1: (0, False), 2: (0, False), 3: (1, True), 4: (1, False), 5: (1, False), 6: (2, True), 7: (2, False), 8: (2, False)}
    again = arrivals.split_late(arrivals.read(spark, f"{base}/in", rows.schema, 1), base)  # nothing new: nothing changes
    assert again.count() == 8


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(4)
    rows = [(k % 9, "abc"[k % 3], int(rng.paretovariate(0.6)) % 5000, rng.expovariate(1 / 30), int(rng.paretovariate(0.8))) for k in range(30_000)] + [(0, "a", None, None, None), (3, None, 7, 1.0, 1)]
    return rows, spark.createDataFrame(rows, "day int, kind string, user int, value double, item int")


def test_merged_sketches_keep_their_bounds(skewed):
    rows, df = skewed
    fine = sketches.daily(df, {"day": F.col("day"), "kind": F.col("kind")}, F.col("user"), F.col("value"), F.col("item"), slots=32)
    by_kind = sketches.rolled(fine, ["kind"], slots=32)
    every = sketches.rolled(by_kind, [], slots=32)
    for level, keys, pick in ((fine, ["day", "kind"], lambda r: (r[0], r[1])), (by_kind, ["kind"], lambda r: (r[1],)), (every, [], lambda r: ())):
        users, values, items = {}, {}, {}
        for r in rows:
            users.setdefault(pick(r), set()).update({r[2]} - {None})
            values.setdefault(pick(r), []).extend([r[3]] if r[3] is not None else [])
            items.setdefault(pick(r), Counter()).update([r[4]] if r[4] is not None else [])
        for r in sketches.members(level, keys).collect():
            exact = len(users[tuple(r[: len(keys)])])
            assert abs(r.by_hll - exact) <= 4 * 1.04 / 64 * exact + 1 and abs(r.by_theta - exact) <= 4 / 64 * exact + 1
        for r in sketches.quantiles(level, keys, [0.1, 0.5, 0.9]).collect():
            own = sorted(values[tuple(r[: len(keys)])])
            for rank, v in zip([0.1, 0.5, 0.9], r.quantiles):
                assert sum(x < v for x in own) <= (rank + sketches.KLL_ERROR) * len(own) and sum(x <= v for x in own) >= (rank - sketches.KLL_ERROR) * len(own)
        n = {k: sum(c.values()) for k, c in items.items()}
        found = {}
        for r in sketches.heavy(level, keys, 0.05).collect():
            key = tuple(r[: len(keys)])
            found.setdefault(key, set()).add(r.item)
            assert r.least <= items[key][r.item] <= r.most <= r.least + n[key] / 33 + 1
        assert all({i for i, k in c.items() if k > 0.05 * n[key]} <= found.get(key, set()) for key, c in items.items())
    assert sketches.rolled(fine.limit(0), ["kind"]).count() == 0
