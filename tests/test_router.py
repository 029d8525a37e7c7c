"""The router: splits, features, models, training and metrics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fusemill.router import dataset, models, training


def sizes(spark, n):
    return tuple(spark.range(1).select(dataset.split_sizes(F.lit(n), (0.7, 0.15, 0.15)).alias("s")).first().s)


def test_split_sizes(spark):
    assert sizes(spark, 4) == (3, 0, 1) and sizes(spark, 0) == (0, 0, 0) and sizes(spark, 1) == (1, 0, 0) and sizes(spark, 20) == (14, 3, 3)
    assert all(sum(sizes(spark, n)) == n for n in (2, 3, 5, 7, 11, 30))


def test_assign_splits_and_balance(spark):
    rows = spark.createDataFrame([(f"q{k}", "a" if k % 3 else "b") for k in range(30)] + [("q1", "a")], "question_id string, dataset_source string")
    out = dataset.assign_splits(rows, "question_id", "dataset_source").collect()
    assert len(out) == 30 and {r.split for r in out} == {"train", "dev", "test"}
    assert sum(r.dataset_source == "b" and r.split == "train" for r in out) == 7 and sum(r.dataset_source == "a" and r.split == "train" for r in out) == 14
    groups = spark.createDataFrame([(f"g{g}-{k}", g) for g, n in enumerate((10, 5, 8, 5, 3)) for k in range(n)], "question_id string, g int")
    kept = dataset.balance_groups(groups, "g", "question_id")
    assert {r.g: r["count"] for r in kept.groupBy("g").count().collect()} == dict.fromkeys(range(5), 3)
    with pytest.raises(ValueError):
        dataset.balance_groups(groups.where("g <> 2"), "g", "question_id")


def features(spark, question, **more):
    return spark.createDataFrame([(question,)], "q string").select(dataset.query_features(F.col("q"), **more).alias("f")).first().f.asDict()


def test_query_features(spark):
    f = features(spark, 'How many films did "Ann Lee" and Bob Roy make before 1999?')
    assert f["quoted_span_count"] == 1 and f["numeric_count_indicator"] == f["temporal_indicator"] == 1.0
    assert f["numeric_or_date_token_count"] == 2 and f["coord_subordination_count"] == 2
    assert f["comparison_indicator"] == 0.0 and features(spark, "Who is older, Ann or Bob?")["comparison_indicator"] == 1.0
    assert f["max_dependency_depth"] == 0.0 and list(f) == dataset.FEATURES
    assert set(features(spark, "  ").values()) == {0.0} and set(features(spark, None).values()) == {0.0}
    linked = features(spark, "where was Ann Lee born", entities=F.array(F.lit("Ann Lee"), F.lit("x")), linked=F.lit(1))
    assert linked["kg_linkable_entity_ratio"] == 0.5 and linked["multi_entity_indicator"] == 1.0 and math.isclose(linked["relation_cue_density"], 1 / 3)
    assert dataset.active_columns(["quoted_span_count"])[:2] == [0, 2]
    with pytest.raises(ValueError):
        dataset.active_columns(dataset.FEATURES)
    with pytest.raises(ValueError):
        dataset.active_columns(["nothing"])


def test_training_table(spark):
    items = spark.createDataFrame([(f"q{k}", f"who made thing {k}" + " more" * (k % 4), "NQ" if k % 2 else " ") for k in range(20)], "question_id string, question string, dataset_source string")
    labels = spark.createDataFrame([(f"q{k}", p, [0.0, float(p)]) for k in range(1, 20) for p in (1, 2)] + [("other", 1, [0.0])], "question_id string, pos int, oracle_curve array<double>")
    vectors = spark.createDataFrame([(f"q{k}", [1.0, float(k)]) for k in range(20)], "question_id string, query_embedding array<double>")
    table, fitted = dataset.training_table(items, labels, vectors)
    out = table.collect()
    assert len(out) == 19 and {r.dataset_source for r in out} == {"nq", "unknown"} and all(r.oracle_curve == [0.0, 2.0] for r in out)
    train = [r for r in out if r.split == "train"]
    raw = np.array([r.feature_vector_raw for r in train])
    k = dataset.FEATURES.index("content_token_len")
    assert math.isclose(fitted["content_token_len"][0], raw[:, k].mean()) and math.isclose(fitted["content_token_len"][1], raw[:, k].std(ddof=1))
    assert fitted["quoted_span_count"] == (0.0, 1.0) and abs(np.mean([r.feature_norm__content_token_len for r in train])) < 1e-9
    asked = items.select("question_id", F.lit("h").alias("text_hash"))
    cache = spark.createDataFrame([("q1", "h", "p", "m", [1.0], 1), ("q1", "h", "p", "m", [2.0], 2), ("q2", "x", "p", "m", [1.0], 1)], "question_id string, text_hash string, provider string, model string, embedding array<double>, pos int")
    got = {r.question_id: r.query_embedding for r in dataset.checked_embeddings(asked, cache, "p", "m", "prefer").collect()}
    assert got["q1"] == [2.0] and got["q2"] is None
    with pytest.raises(ValueError):
        dataset.checked_embeddings(asked, cache, "p", "m")
    assert dataset.cache_mode("openai", "auto") == "required" and dataset.cache_mode("sentence-transformers", "auto") == "off" and dataset.cache_mode("x", "build") == "build"
    flags = spark.createDataFrame([("test", "b", True), ("test", "a", False), ("test", "a", None)], "split string, question_id string, valid boolean")
    (s,), (i,) = dataset.split_ids(flags).collect(), dataset.ignored_ids(flags).collect()
    assert (s.question_ids, s.total, s.eligible, s.ignored) == (["a", "b"], 3, 1, 2) and (i.question_ids, i.total) == (["a"], 1)
    named = flags.withColumnRenamed("valid", "is_valid_for_router_training")
    assert dataset.eligible(named, "regression").count() == dataset.eligible(named, "classification").count() == 1


@pytest.mark.parametrize("name", sorted(models.ARCHITECTURES))
def test_gradients(name):
    rng = np.random.default_rng(3)
    m = models.architecture(name)(3, 2, rng, hidden=6)
    x, t = rng.normal(size=(5, 5)), rng.normal(size=5)
    slope = lambda z: ((z - t) ** 2, 2 * (z - t))
    _, grads = m.gradient(x, slope)
    assert [g.shape for g in grads] == [p.shape for p in m.parameters]
    for p, g in zip(m.parameters, grads, strict=True):
        for at in [tuple(rng.integers(0, s) for s in p.shape) for _ in range(4)]:
            keep, e = p[at], 1e-6
            p[at] = keep + e
            up = ((m.score(x) - t) ** 2).sum()
            p[at] = keep - e
            down = ((m.score(x) - t) ** 2).sum()
            p[at] = keep
            assert math.isclose(g[at], (up - down) / (2 * e), rel_tol=1e-4, abs_tol=1e-6)
    assert np.allclose(models.Model.loads(m.dumps()).score(x), m.score(x))


def test_losses():
    curve = np.array([[1.0, 0, 0], [0, 0.5, 1.0], [0.2, 0.9, 0.2]])
    w = np.array([0.3, 0.6, 0.8])
    assert np.allclose(models._regret(w, curve)[0], [1 - 0.4, 1 - 0.6, 0.9 - 0.48])
    for loss in (models.regret_loss(), models.hinge_squared_loss(0.1), models.boundary_magnet_loss()):
        value, slope = loss(w, curve)
        assert np.allclose(slope, (loss(w + 1e-7, curve)[0] - loss(w - 1e-7, curve)[0]) / 2e-7, atol=1e-4)
    tie, _ = models.boundary_magnet_loss(0.0, 0.0)(np.array([0.5]), np.array([[1.0, 0.0]]))
    assert tie[0] == 0.25  # half way counts from 0
    assert models.resolve_loss("Hinge-Squared-Regret")[1:] == ("hinge_squared_regret", False) and models.resolve_loss("odd")[1:] == ("regret", True)
    assert models.resolve_loss(None)[1:] == ("regret", False)
    p, t = np.array([0.3, 0.8]), np.array([1.0, 0.0])
    assert np.allclose(models.cross_entropy(p, t, (2.0, 1.0))[0], [-math.log(0.3), -2 * math.log(0.2)])
    assert models.monomial_count(3, 2) == 9 and models.monomial_count(0, 2) == 0
    with pytest.raises(ValueError):
        models.architecture("polynomial")(400, 400, np.random.default_rng(0), degree=3)
    with pytest.raises(ValueError):
        models.architecture("none")


def rows_of(spark, n=120):
    rng = np.random.default_rng(5)
    data = []
    for k in range(n):
        e = rng.normal(size=3)
        dense = int(e[0] > 0)
        data.append((f"q{k}", ("train", "dev", "test")[k % 3], "a" if k % 4 else "b", e.tolist(), [0.5, 0.1], [1.0, 0.5, 0.0] if not dense else [0.0, 0.5, 1.0], [0.0, 0.5, 1.0], dense, k != 7))
    df = spark.createDataFrame(data, "question_id string, split string, dataset_source string, e array<double>, f array<double>, oracle_curve array<double>, weight_grid array<double>, target int, valid boolean")
    return df.withColumn("x", training.inputs(F.col("e"), F.col("f"), "both"))


def test_train_and_evaluate(spark):
    rows = rows_of(spark)
    fit = training.train(rows, 3, 2, "linear", epochs=25, rate=0.3)
    assert fit.history[-1]["train"] < fit.history[0]["train"] and fit.loss == "regret" and not fit.fallback
    pred = training.predictions(fit, rows)
    out = {r.split: r for r in training.metrics(pred).collect()}
    assert set(out) == {"train", "dev", "test"} and out["test"].mean_regret < 0.15 and out["train"].n == 40 - 1 * (7 % 3 == 0)
    assert math.isclose(out["test"].normalised_regret, out["test"].mean_regret) and out["test"].rmse >= out["test"].mae
    hard = training.train(rows, 3, 2, "mlp", task="classification", epochs=12, rate=0.05, hidden=8)
    got = training.predictions(hard, rows).select("split", "predicted.*", "valid", "question_id").join(rows.select("question_id", "target"), "question_id")
    accuracy = {r.split: r.accuracy for r in training.class_metrics(got).collect()}
    assert accuracy["test"] > 0.8
    (one,) = got.where("question_id = 'q0'").collect()
    assert math.isclose(sum(one.probs), 1) and one.confidence == max(one.probs)
    with pytest.raises(ValueError):
        training.train(rows.where("split = 'dev'"), 3, 2, epochs=1)
    zeros = rows.select(training.inputs(F.col("e"), F.col("f"), "query-features").alias("x")).first().x
    assert zeros[:3] == [0.0] * 3 and zeros[3:] == [0.5, 0.1]
    training.compatible({"provider": "p", "model": "m", "dim": 3}, {"provider": "p", "model": "m", "dim": 3})
    with pytest.raises(ValueError):
        training.compatible({"provider": "p", "model": "m", "dim": 3}, {"provider": "p", "model": "m", "dim": 4})


def test_metrics_by_hand(spark):
    rows = [("s", 0.5, [1.0, 0.0, 0.0], True), ("s", 0.5, [0.0, 0.0, 1.0], True), ("s", 0.0, [9.0, 9.0, 9.0], False), ("p", 0.7, [0.0, 1.0, 1.0], True)]
    df = spark.createDataFrame(rows, "split string, predicted_weight double, oracle_curve array<double>, valid boolean").withColumn("weight_grid", F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0)))
    out = {r.split: r for r in training.metrics(df).collect()}
    assert (out["s"].n, out["s"].mean_regret, out["s"].normalised_regret, out["s"].mae) == (2, 1.0, 1.0, 0.5) and out["p"].mae == 0.0
