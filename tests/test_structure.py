"""Depths of parent pointers, cycles included, and runs of a table function."""

import random

from pyspark.sql import functions as F

from fusemill.operators import runs, trees


def depth_plain(parents, i):
    seen, d = set(), 0
    while parents.get(i) in parents:
        if i in seen:
            return None, None
        seen.add(i)
        i, d = parents[i], d + 1
    return d, i


def test_depths_of_chains_trees_and_cycles(spark):
    rng = random.Random(1)
    parents = {k: rng.randrange(k) if k and rng.random() < 0.95 else None for k in range(120)}
    parents |= {200 + k: 199 + k for k in range(1, 40)} | {200: None}  # a chain
    parents |= {300: 301, 301: 302, 302: 300, 303: 300, 304: 303, 305: 305}  # a cycle, what hangs on it, a loop
    parents |= {400: 999}  # a parent that isn't there
    df = spark.createDataFrame([*parents.items(), (5, parents[5]), (None, 3)], "id int, parent int")
    got = {r.id: (r.depth, r.root) for r in trees.depths(df).collect()}
    assert got == {i: depth_plain(parents, i) for i in parents}
    assert trees.depths(df.limit(0)).count() == 0


def test_runs_by_key(spark):
    rows = [(1, "a", 1), (1, "a", 2), (1, "b", 3), (1, "a", 4), (2, None, 1), (2, None, 2), (2, "a", 3), (None, "a", 1)]
    df = spark.createDataFrame(rows, "key long, value string, s int").select("key", "value", F.timestamp_seconds("s").alias("at"))
    out = spark.sql(f"SELECT * FROM {runs.register(spark)}(TABLE(SELECT * FROM {{df}}) PARTITION BY key ORDER BY at)", df=df)
    got = sorted(((r.key, r.value, r.n, r.first.second, r.last.second) for r in out.collect()), key=str)
    assert got == sorted([(1, "a", 2, 1, 2), (1, "b", 1, 3, 3), (1, "a", 1, 4, 4), (2, None, 2, 1, 2), (2, "a", 1, 3, 3), (None, "a", 1, 1, 1)], key=str)
