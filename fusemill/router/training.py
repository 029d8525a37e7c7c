"""Training and use of router models on DataFrames.

A step's gradient is a sum over rows: each partition sends one row of sums, so the table is never gathered, and any number of questions trains alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fusemill.checkpoint import cut
from fusemill.operators import curves
from fusemill.router import models


def inputs(embedding: Column, features: Column, mode: str = "both") -> Column:
    """One input array: query vector, then features; what the mode leaves out is 0."""
    zero = lambda c: F.transform(c, lambda _: F.lit(0.0))
    as_double = lambda c: F.transform(F.coalesce(c, F.array().cast("array<double>")), lambda x: x.cast("double"))
    e, f = as_double(embedding), as_double(features)
    if mode not in ("both", "embedding", "query-features"):
        raise ValueError(f"unknown input mode: {mode}")
    return F.concat(e if mode != "query-features" else zero(e), f if mode != "embedding" else zero(f))


@dataclass
class Trained:
    model: models.Model
    task: str
    best_epoch: int
    loss: str
    fallback: bool
    history: list[dict[str, float]] = field(default_factory=list)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.float64) for x in column])


def train(
    rows: DataFrame,
    embedding: int,
    features: int,
    architecture: str = "linear",
    task: str = "regression",
    loss: str | None = None,
    loss_options: dict[str, float] | None = None,
    epochs: int = 100,
    rate: float = 0.05,
    decay: float = 1e-4,
    patience: int = 20,
    clip: float = 1.0,
    seed: int = 42,
    **options,
) -> Trained:
    """Fit a model; AdamW on the full gradient, clipped, each source weighing the same; the state of the least dev loss stays.

    rows: split, dataset_source, x (array of embedding + features doubles), oracle_curve, target (dense class, 0 or 1), valid. Rows that aren't valid, and
    those of other splits than train and dev, take no part. Without a dev row the train loss decides.
    """
    model = models.architecture(architecture)(embedding, features, np.random.default_rng(seed), **options)
    per_weight, name, fallback = models.resolve_loss(loss, **(loss_options or {}))
    fit = rows.where(F.coalesce("valid", F.lit(False)) & F.col("split").isin("train", "dev"))
    per_source = fit.groupBy("split", "dataset_source").agg(F.count(F.lit(1)).alias("n"))
    weighed = fit.join(F.broadcast(per_source) if per_source.limit(10_001).count() <= 10_000 else per_source, ["split", "dataset_source"])
    table = cut(weighed.select("split", "x", "oracle_curve", F.col("target").cast("double").alias("target"), (1 / F.col("n")).alias("w")))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {}
        for batch in batches:
            for split, part in batch.groupby("split"):
                x, w = _matrix(part["x"]), part["w"].to_numpy()
                curve, target = _matrix(part["oracle_curve"]), part["target"].to_numpy()

                def slope(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                    p = models.sigmoid(z)
                    if task == "classification":
                        value, d = models.cross_entropy(p, target)  # noqa: B023
                    else:
                        value, by_weight = per_weight(p, curve)  # noqa: B023
                        d = by_weight * p * (1 - p)
                    return value * w, d * w  # noqa: B023

                value, grads = model.gradient(x, slope)
                old = total.get(split, (0.0, 0.0, 0.0))
                total[split] = (old[0] + value, old[1] + float(w.sum()), old[2] + np.concatenate([g.ravel() for g in grads]))
        yield pd.DataFrame([(s, v, w, g.tolist()) for s, (v, w, g) in total.items()], columns=["split", "loss", "w", "g"])

    size = sum(p.size for p in model.parameters)
    first, second = np.zeros(size), np.zeros(size)
    best, best_at, best_state, history = np.inf, 0, [p.copy() for p in model.parameters], []
    for epoch in range(1, epochs + 1):
        got = table.mapInPandas(sums, "split string, loss double, w double, g array<double>").groupBy("split").agg(F.sum("loss").alias("loss"), F.sum("w").alias("w"), F.collect_list("g").alias("g")).collect()
        by = {r["split"]: r for r in got}
        if "train" not in by:
            raise ValueError("no valid row of the train split")
        mean = lambda s: by[s]["loss"] / by[s]["w"] if s in by else None  # noqa: B023, E731
        judged = mean("dev") if "dev" in by else mean("train")
        history.append({"epoch": epoch, "train": mean("train"), "dev": judged})
        if judged < best - 1e-12:
            best, best_at, best_state = judged, epoch, [p.copy() for p in model.parameters]
        elif epoch - best_at >= patience:
            break
        g = np.sum(by["train"]["g"], axis=0) / by["train"]["w"]
        g *= min(1.0, clip / max(1e-12, float(np.linalg.norm(g))))
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        step = rate * (first / (1 - 0.9**epoch)) / (np.sqrt(second / (1 - 0.999**epoch)) + 1e-8)
        at = 0
        for p in model.parameters:
            p -= step[at : at + p.size].reshape(p.shape) + rate * decay * p
            at += p.size
    for p, b in zip(model.parameters, best_state, strict=True):
        p[...] = b
    return Trained(model, task, best_at, name, fallback, history)


def _scores(model: models.Model, x: Column) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            yield pd.Series(models.sigmoid(model.score(_matrix(part))) if len(part) else [], dtype="float64")

    return F.pandas_udf(run, "double")(x)


def predict_weight(model: models.Model, x: Column) -> Column:
    """The dense weight, 0 to 1."""
    return _scores(model, x)


def predict_class(model: models.Model, x: Column) -> Column:
    """struct(probs (graph, dense), class_id, confidence); the dense class wins a tie."""
    p = _scores(model, x)
    return F.struct(F.array(1 - p, p).alias("probs"), (p >= 0.5).cast("int").alias("class_id"), F.greatest(p, 1 - p).alias("confidence"))


def predictions(trained: Trained, rows: DataFrame) -> DataFrame:
    """question_id, split, dataset_source, predicted weight or class, oracle_curve, weight_grid, valid."""
    made = predict_weight(trained.model, F.col("x")).alias("predicted_weight") if trained.task == "regression" else predict_class(trained.model, F.col("x")).alias("predicted")
    return rows.select("question_id", "split", "dataset_source", made, "oracle_curve", "weight_grid", "valid")


def metrics(rows: DataFrame) -> DataFrame:
    """split and over its valid rows: n, mean_regret, normalised_regret, interval distance mae and rmse, regret of each quarter of the curves' spread.

    rows: split, predicted_weight, oracle_curve, weight_grid, valid. The quarters are cut over all rows of a split, valid or not.
    """
    c, w = F.col("oracle_curve"), F.col("predicted_weight")
    made = cut(rows.select("split", F.coalesce("valid", F.lit(False)).alias("valid"), curves.spread(c).alias("spread"), curves.regret(c, w).alias("regret"), F.array_max(c).alias("best"), curves.distance(w, curves.intervals(c, F.col("weight_grid"))).alias("d")))
    cuts = made.groupBy("split").agg(F.percentile("spread", [0.25, 0.5, 0.75]).alias("q"))
    met = made.join(cuts, "split").where("valid")
    quarter = F.when(F.col("spread") <= F.col("q")[0], 1).when(F.col("spread") <= F.col("q")[1], 2).when(F.col("spread") <= F.col("q")[2], 3).otherwise(4)
    parts = [F.coalesce(F.avg(F.when(quarter == k, F.col("regret"))), F.lit(0.0)).alias(f"regret_q{k}") for k in range(1, 5)]
    return met.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("regret").alias("mean_regret"),
        (F.avg("regret") / F.greatest(F.lit(1e-12), F.avg("best"))).alias("normalised_regret"),
        F.avg("d").alias("mae"),
        F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"),
        *parts,
    )


def class_metrics(rows: DataFrame) -> DataFrame:
    """split, n, accuracy of valid rows. rows: split, class_id, target, valid."""
    return rows.where("valid").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("class_id") == F.col("target")).cast("double")).alias("accuracy"))


def compatible(model: dict, data: dict) -> None:
    """Refuse a model whose vectors aren't those of the data: provider, model name and dimension must agree."""
    for key in ("provider", "model", "dim"):
        if model.get(key) != data.get(key):
            raise ValueError(f"the model's {key} is {model.get(key)!r}, the data's {data.get(key)!r}")
