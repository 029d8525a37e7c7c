"""Summaries behind the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fusemill.operators import quantiles


def latency_summary(calls: DataFrame, key: str, ms: Column, digits: int = 6) -> DataFrame:
    """key, n, valid, missing, mean, p50, p90, p95, std (of the sample), lo and hi of the calls of each key; quantiles are exact, by rank. A key without a valid call has nulls."""
    v = calls.select(key, ms.cast("double").alias("ms"))
    plain = v.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count("ms").alias("valid"), F.count_if(F.col("ms").isNull()).alias("missing"), F.round(F.avg("ms"), digits).alias("mean"), F.round(F.stddev_samp("ms"), digits).alias("std"), F.min("ms").alias("lo"), F.max("ms").alias("hi")
    )
    q = quantiles.exact(v, [key], F.col("ms"), [0.5, 0.9, 0.95]).withColumnRenamed(key, "_key").drop("n")
    both = plain.join(q, F.col(key).eqNullSafe(F.col("_key")), "left")
    at = lambda k: F.round(F.get("quantiles", F.lit(k)), digits)
    return both.select(key, "n", "valid", "missing", "mean", at(0).alias("p50"), at(1).alias("p90"), at(2).alias("p95"), "std", "lo", "hi")


def by_split(rows: DataFrame, split: Column, value: Column, failed: Column, limit: float, digits: int = 6) -> DataFrame:
    """split (and all), n, mean_value and flaky: whether more than ``limit`` of the rows failed. Null values don't count in the mean."""
    base = rows.select(split.alias("split"), value.alias("v"), failed.cast("int").alias("f"))
    out = base.groupingSets([["split"], []], "split").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), digits).alias("mean_value"), (F.sum("f") / F.count(F.lit(1)) > limit).alias("flaky"))
    return out.withColumn("split", F.coalesce("split", F.lit("all")))


def rolled_mean(rows: DataFrame, key: Column, value: Column, name: str, digits: int = 6) -> DataFrame:
    """key (under ``name``, and all), n and accuracy, the mean of ``value``."""
    base = rows.select(key.alias(name), value.cast("double").alias("v"))
    out = base.groupingSets([[name], []], name).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), digits).alias("accuracy"))
    return out.withColumn(name, F.coalesce(name, F.lit("all")))


def answerability(rows: DataFrame, key: str, answerable: Column) -> DataFrame:
    """key, n, any_answerable, answerable and unanswerable; a null verdict is neither."""
    n = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), n(answerable).alias("answerable"), n(~answerable).alias("unanswerable"))
    return out.withColumn("any_answerable", F.col("answerable") > 0)


def masks(id_col: str, **reasons: DataFrame) -> DataFrame:
    """id and reason of every id in one of the tables: the first reason by name, where several apply."""
    each = [df.select(id_col).distinct().withColumn("reason", F.lit(r)) for r, df in sorted(reasons.items())]
    out = each[0]
    for df in each[1:]:
        out = out.unionByName(df)
    return out.groupBy(id_col).agg(F.min("reason").alias("reason"))


def best_trials(trials: DataFrame, sweep: str, trial: str, score: str) -> DataFrame:
    """sweep, trial_index and score of each sweep's best trial, the smaller index of equals; null scores count as the worst. A partial aggregate: no sweep is sorted."""
    best = F.min(F.struct(F.col(score).isNull().alias("nil"), (-F.col(score)).alias("neg"), F.col(trial).alias("trial")))
    return trials.groupBy(F.col(sweep).alias("sweep")).agg(best.alias("b")).select("sweep", F.col("b.trial").alias("trial_index"), (-F.col("b.neg")).alias("score"))


def threshold_sweep(rows: DataFrame, score: Column, objective: Column, thresholds: list[float], digits: int = 6) -> DataFrame:
    """threshold, mean_objective (0 below the threshold) and fallback_rate, for all thresholds in one pass: rows aren't multiplied."""
    base = rows.select(score.cast("double").alias("s"), objective.cast("double").alias("o"))
    sums = [a for k, t in enumerate(thresholds) for a in (F.avg(F.when(F.col("s") >= t, F.col("o")).otherwise(0.0)).alias(f"o{k}"), F.avg((F.col("s") < t).cast("int")).alias(f"f{k}"))]
    each = [F.struct(F.lit(float(t)).alias("threshold"), F.round(F.col(f"o{k}"), digits).alias("mean_objective"), F.round(F.col(f"f{k}"), digits).alias("fallback_rate")) for k, t in enumerate(thresholds)]
    return base.agg(*sums).select(F.explode(F.array(*each)).alias("r")).select("r.*")


def distinct_members(rows: DataFrame, key: Column, name: str, member: str, count: str) -> DataFrame:
    """key (under ``name``) and the number of distinct members."""
    return rows.groupBy(key.alias(name)).agg(F.count_distinct(member).alias(count))


def standardised(rows: DataFrame, fitted: DataFrame, values: list[str], digits: int = 6) -> DataFrame:
    """``rows`` with z_<value> of each value by mean and sample deviation over ``fitted``; a deviation under 1e-8, or of fewer than two rows, is 1, and the mean of nothing 0."""
    r = fitted.agg(*[a for v in values for a in (F.avg(F.col(v).cast("double")).alias(f"m_{v}"), F.stddev_samp(F.col(v).cast("double")).alias(f"s_{v}"))]).first()
    wide = lambda s: s if s is not None and s >= 1e-8 else 1.0
    return rows.withColumns({f"z_{v}": F.round((F.col(v).cast("double") - (r[f"m_{v}"] or 0.0)) / wide(r[f"s_{v}"]), digits) for v in values})
