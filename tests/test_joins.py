"""Interval joins, nearest points and exact quantiles against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fusemill.operators import intervals, quantiles, reports


def test_points_meet_their_intervals_once(spark):
    rng = random.Random(3)
    points = [(k, rng.uniform(-500, 500)) for k in range(300)] + [(300, None), (301, 0.0), (301, 0.0)]
    spans = [(k, a, a + rng.choice([0, 0.4, 3, 70, 1000])) for k in range(120) for a in [rng.uniform(-500, 500)]] + [(120, -1000.0, 1000.0), (121, 5.0, 4.0), (122, None, 4.0), (123, 0.0, 0.0)]
    p, s = spark.createDataFrame(points, "p int, at double"), spark.createDataFrame(spans, "s int, start double, end double")
    want = sorted((i, j) for i, x in points for j, a, b in spans if x is not None and a is not None and a <= x <= b)
    for least in (0.25, 10.0):
        assert sorted((r.p, r.s) for r in intervals.contained(p, s, least).collect()) == want
    assert intervals.contained(p, s.limit(0)).count() == 0 == intervals.contained(p.limit(0), s).count()
    keyed = intervals.contained(p.withColumn("g", F.col("p") % 3), s.withColumn("g", F.col("s") % 3), 1.0, ["g"])
    assert sorted((r.p, r.s) for r in keyed.collect()) == [(i, j) for i, j in want if i % 3 == j % 3]


def test_interval_plans_compare_no_pairs(spark, capsys):
    p, s = spark.createDataFrame([(1, 1.0)], "p int, at double"), spark.createDataFrame([(1, 1.0, 2.0)], "s int, start double, end double")
    intervals.contained(p, s).explain()
    assert not {"NestedLoop", "Cartesian"} & set(capsys.readouterr().out.replace("Join", " ").split())


def test_overlaps_are_found_once(spark):
    rng = random.Random(5)
    make = lambda n: [(k, a, a + rng.choice([0, 1, 8, 300])) for k in range(n) for a in [rng.randint(0, 400)]]
    a, b = make(80), make(90)
    got = intervals.overlapping(spark.createDataFrame(a, "id_a int, start long, end long"), spark.createDataFrame(b, "id_b int, start long, end long"))
    assert sorted(map(tuple, got.collect())) == sorted((i, j) for i, s, e in a for j, t, u in b if s <= u and t <= e)


@pytest.mark.parametrize("bin_rows", [1, 5, 100_000])
def test_nearest_points_over_bins(spark, bin_rows):
    rng = random.Random(bin_rows)
    left = [(k, rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(0, 1000, 7)])) for k in range(200)]
    right = [(rng.choice([1, 1, 2, None]), rng.choice([None, rng.randint(-50, 1100)])) for _ in range(90)]
    out = intervals.nearest(spark.createDataFrame(left, "id int, k int, at long"), spark.createDataFrame(right, "k int, at long"), "k", bin_rows)
    got = {r.id: r.near for r in out.collect()}
    assert len(got) == 200
    for i, k, at in left:
        near = [x for j, x in right if j == k and k is not None and x is not None]
        want = min(near, key=lambda x: (abs(x - at), x)) if near and at is not None else None
        assert got[i] == want, (i, k, at)


@pytest.mark.parametrize("few", [0, 3, 50, 10_000])
def test_quantiles_by_rank(spark, few):
    rng = random.Random(few)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([rng.paretovariate(0.3), 7.0, -rng.expovariate(1), 1e-300])) for _ in range(900)] + [("c", 5.0), ("d", None), ("e", float("nan")), ("f", 1.0), ("f", 2.0), ("g", 3.0)] + [("g", 3.0)] * 40
    ranks = [0.0, 0.1, 0.5, 0.9, 1.0]
    df = spark.createDataFrame(rows, "key string, x double")
    got = {r.key: (r.n, r.quantiles) for r in quantiles.exact(df, ["key"], F.col("x"), ranks, bins=8, few=few).collect()}
    own = {}
    for k, x in rows:
        if x is not None and not math.isnan(x):
            own.setdefault(k, []).append(x)
    assert {k: n for k, (n, _) in got.items()} == {k: len(v) for k, v in own.items()}
    for k, v in own.items():
        assert np.allclose(got[k][1], np.quantile(v, ranks), rtol=1e-12, atol=1e-305)
    every = quantiles.exact(df, [], F.col("x"), ranks, bins=8, few=few).first()
    assert np.allclose(every.quantiles, np.quantile(sum(own.values(), []), ranks), rtol=1e-12, atol=1e-305)
    assert quantiles.exact(df.limit(0), ["key"], F.col("x"), ranks).count() == 0


def test_latency_summary(spark):
    df = spark.createDataFrame([("d", 10.0), ("d", 20.0), ("d", None), ("d", None), ("d", None), ("e", None)], "stage string, ms double")
    rows = {r.stage: r for r in reports.latency_summary(df, "stage", F.col("ms")).collect()}
    assert (rows["d"].n, rows["d"].valid, rows["d"].missing, rows["d"].mean, rows["d"].p50, rows["d"].p90) == (5, 2, 3, 15.0, 15.0, 19.0)
    assert (rows["e"].n, rows["e"].valid, rows["e"].p50, rows["e"].mean) == (1, 0, None, None)
