"""Report operators against hand-made values: nulls, ties and keys without rows."""

from pyspark.sql import functions as F

from fusemill.operators import entities, reports


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_splits_and_means(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", None, False), ("b", 3.0, False)], "s string, v double, bad boolean")
    assert rows(reports.by_split(df, F.col("s"), F.col("v"), F.col("bad"), 0.4)) == [("a", 2, 1.0, True), ("all", 3, 2.0, False), ("b", 1, 3.0, False)]
    assert rows(reports.rolled_mean(df, F.col("s"), F.col("v"), "s")) == [("a", 2, 1.0), ("all", 3, 2.0), ("b", 1, 3.0)]
    assert rows(reports.distinct_members(df, F.col("s"), "key", "bad", "n")) == [("a", 2), ("b", 1)]


def test_answerability_and_masks(spark):
    df = spark.createDataFrame([("x", 1), ("x", 0), ("x", None), ("y", 0)], "src string, q int")
    out = reports.answerability(df, "src", F.col("q") == 1).select("src", "n", "answerable", "unanswerable", "any_answerable")
    assert rows(out) == [("x", 3, 1, 1, True), ("y", 1, 0, 1, False)]
    ids = lambda *k: spark.createDataFrame([(i,) for i in k], "id int")
    assert rows(reports.masks("id", balance=ids(1, 2, 2), audit=ids(2, 3))) == [(1, "balance"), (2, "audit"), (3, "audit")]


def test_best_trials(spark):
    df = spark.createDataFrame([(1, 5, 0.3), (1, 4, 0.9), (1, 3, 0.9), (1, 2, None), (2, 7, None), (2, 6, -1.0), (3, 1, None)], "s int, t int, x double")
    assert rows(reports.best_trials(df, "s", "t", "x")) == [(1, 3, 0.9), (2, 6, -1.0), (3, 1, None)]


def test_threshold_sweep(spark):
    df = spark.createDataFrame([(0.1, 1.0), (0.5, 2.0), (0.9, 3.0)], "s double, o double")
    assert rows(reports.threshold_sweep(df, F.col("s"), F.col("o"), [0.0, 0.5, 1.0])) == [(0.0, 2.0, 0.0), (0.5, round(5 / 3, 6), round(1 / 3, 6)), (1.0, 0.0, 1.0)]


def test_standardised(spark):
    df = spark.createDataFrame([(1, 1.0, 5), (2, 3.0, 5), (3, None, 5)], "k int, v double, w int")
    assert rows(reports.standardised(df, df, ["v", "w"]).select("k", "z_v", "z_w")) == [(1, -0.707107, 0.0), (2, 0.707107, 0.0), (3, None, 0.0)]
    assert rows(reports.standardised(df, df.limit(0), ["v"]).select("k", "z_v")) == [(1, 1.0), (2, 3.0), (3, None)]


def test_lexicon(spark):
    m = spark.createDataFrame([("a", "A", 1), ("a", "A", 1), ("a", "B", 2), ("a", "C", 2), ("", "x", 1), (None, "x", 1), ("b", None, 3), ("c", "c", None)], "norm string, surface string, chunk_id int")
    assert rows(entities.lexicon(m, 2).select("norm", "surface", "n", "df")) == [("a", "A", 2, 2), ("a", "B", 1, 2), ("c", "c", 1, 0)]
