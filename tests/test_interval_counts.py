"""Counts over intervals against brute force, in blocks small enough that several meet."""

import random

from fusemill.operators import intervals

SPANS = "key long, start long, end long, own long"


def made(rng):
    """Events (key, at, id) and each key's runs without a gap of 6 or more."""
    points = [(rng.choice([*range(25), None]), rng.randrange(150), k if k % 17 else None) for k in range(260)]
    spans = []
    for key in range(25):
        at = sorted(t for u, t, _ in points if u == key)
        for t in at:
            if spans and spans[-1][0] == key and t - spans[-1][2] < 6:
                spans[-1] = (key, spans[-1][1], t, spans[-1][3] + 1)
            else:
                spans.append((key, t, t, 1))
    return points, spans


def test_counts_equal_pairs(spark, monkeypatch):
    points, spans = made(random.Random(9))
    p, s = spark.createDataFrame(points, "key long, at long, id long"), spark.createDataFrame([*spans, (None, 3, 9, 1)], SPANS)
    want = {}
    for k, a, b, _ in spans:
        met = [i for u, t, i in points if u is not None and u != k and a <= t <= b]
        if met:
            want[k, a] = (len(met), min((i for i in met if i is not None), default=None))
    pairs = {}
    for k, a, b, _ in spans:
        met = [u for u, c, d, _ in spans if u != k and a <= d and c <= b]
        if met:
            n, keys = pairs.get(k, (0, set()))
            pairs[k] = (n + len(met), keys | set(met))
    for instants, keys in ((1 << 16, 1 << 14), (4, 6)):
        monkeypatch.setattr(intervals, "INSTANTS", instants)
        monkeypatch.setattr(intervals, "KEYS", keys)
        assert {(r.key, r.start): (r.n, r.first_id) for r in intervals.others_within(p, s).collect()} == want
        assert {r.key: (r.n, r["keys"]) for r in intervals.overlap_counts(s.drop("own")).collect()} == {k: (n, len(u)) for k, (n, u) in pairs.items()}
    assert intervals.overlap_counts(s.limit(0)).count() == 0 == intervals.others_within(p.limit(0), s.limit(0)).count()


def test_no_pairs_are_made(spark, capsys):
    """A thousand keys that are all open together: pairs would be a million rows."""
    s = spark.range(1000).selectExpr("id AS key", "id AS start", "2000 AS end", "1L AS own")
    out = intervals.overlap_counts(s).collect()
    assert {(r.n, r["keys"]) for r in out} == {(999, 999)} and len(out) == 1000
    intervals.overlap_counts(s).explain()
    assert "Join" not in capsys.readouterr().out
