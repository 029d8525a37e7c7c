"""The keyed store: what it answers, what a put rewrites, and what a read moves."""

import os

from pyspark.sql import functions as F

from fusemill.sources.store import Store


def opened(spark, tmp_path, **more):
    return Store(spark, "k BIGINT, v STRING", "k", 4, path=str(tmp_path / "store"), **more)


def kv(spark, *rows):
    return spark.createDataFrame(list(rows), "k long, v string")


def files(path):
    return {os.path.join(at, n): os.stat(os.path.join(at, n)).st_mtime_ns for at, _, ns in os.walk(path) for n in ns if n.endswith(".parquet")}


def held(store):
    return sorted((r.k, r.v) for r in store.rows().collect())


def test_get_put_and_null_keys(spark, tmp_path):
    store = opened(spark, tmp_path)
    assert held(store) == []
    store.put(kv(spark))
    store.put(kv(spark, (1, "a"), (2, None), (None, "lost")))
    store.put(kv(spark, (2, "b"), (3, "c")))
    assert held(store) == [(1, "a"), (2, "b"), (3, "c")]
    assert [tuple(r) for r in store.get(kv(spark, (3, "x"), (3, "y"), (9, "z"), (None, ""))).collect()] == [(3, "c")]


def test_last_of_a_key_counts(spark, tmp_path):
    store = opened(spark, tmp_path)
    store.put(kv(spark, (1, "b"), (1, "c"), (1, "a")), order="v")
    assert held(store) == [(1, "c")]


def test_only_missing_keys_are_fetched_and_once(spark, tmp_path):
    store, asked = opened(spark, tmp_path), []

    def fetch(keys):
        got = sorted(r.k for r in keys.collect())
        asked.append(got)
        return kv(spark, *[(k, f"new {k}") for k in got if k != 8])

    store.put(kv(spark, (1, "a")))
    wanted = kv(spark, (1, ""), (5, ""), (5, ""), (8, ""), (None, ""))
    assert sorted(tuple(r) for r in store.get_or_fetch(wanted, fetch).collect()) == [(1, "a"), (5, "new 5")]
    store.get_or_fetch(wanted, fetch)
    assert asked == [[5, 8], [8]]


def test_a_lazy_fetch_runs_once(spark, tmp_path):
    store, ran = opened(spark, tmp_path), spark.sparkContext.accumulator(0)

    def counted(k):
        ran.add(1)
        return f"new {k}"

    made = F.udf(counted, "string")
    assert store.get_or_fetch(kv(spark, *[(k, "") for k in range(20)]), lambda keys: keys.select("k", made("k").alias("v"))).count() == 20
    assert ran.value == 20


def test_put_rewrites_the_touched_buckets_only(spark, tmp_path):
    store = opened(spark, tmp_path)
    store.put(kv(spark, *[(k, "a") for k in range(200)]))
    before = files(store.path)
    assert len(before) == 4
    store.put(kv(spark, (7, "b")))
    after = files(store.path)
    assert len(set(before) & set(after)) == 3
    assert all(before[f] == after[f] for f in set(before) & set(after))
    assert held(store) == [(k, "b" if k == 7 else "a") for k in range(200)]


def test_opened_again_finds_its_rows(spark, tmp_path):
    opened(spark, tmp_path).put(kv(spark, (1, "a"), (2, "b")))
    assert held(opened(spark, tmp_path)) == [(1, "a"), (2, "b")]


def test_stores_join_without_an_exchange(spark, tmp_path):
    store = opened(spark, tmp_path)
    store.put(kv(spark, *[(k, "a") for k in range(50)]))
    other = Store(spark, "k BIGINT", "k", 4, path=str(tmp_path / "other"))
    other.put(spark.range(20, 80).withColumnRenamed("id", "k"))
    both = store.get(other.rows())
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.k for r in both.collect()) == list(range(20, 50))
    missing = store.misses(other.rows())
    assert "Exchange" not in missing._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.k for r in missing.collect()) == list(range(50, 80))
