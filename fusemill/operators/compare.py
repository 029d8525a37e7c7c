"""Reports over evaluated runs: rerank, compare, bootstrap, and the tables behind the figures."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fusemill.operators import curves, ranking


def rerank(hits: DataFrame, scores: DataFrame | None, k: int) -> DataFrame:
    """The ``k`` best by a second score, equal ones as they stood, with old_score; without ``scores`` the first ``k`` as they stand.

    hits: question_id, chunk_id, score, rank; scores: question_id, chunk_id, new_score. Chunks without a second score come last.
    """
    if scores is None:
        return hits.where(F.col("rank") < k).withColumn("old_score", F.lit(None).cast("double"))
    joined = hits.join(scores, ["question_id", "chunk_id"], "left")
    listed = joined.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct((-F.coalesce("new_score", F.lit(float("-inf")))).alias("o"), "rank", "chunk_id", "score", "new_score"))).alias("x"))
    each = listed.select("question_id", F.posexplode(F.slice("x", 1, k)).alias("rank", "c"))
    return each.select("question_id", "c.chunk_id", F.col("c.new_score").alias("score"), "rank", F.col("c.score").alias("old_score"))


def preview(chunks: Column, k: int, chars: int) -> Column:
    """The first ``k`` chunks (rank, chunk_id, score, text) with ``chars`` characters of text; 0 shows it whole."""
    cut = lambda t: F.when(F.length(t) > chars, F.concat(F.substr(t, F.lit(1), F.lit(chars)), F.lit("…"))).otherwise(t) if chars > 0 else t
    return F.transform(F.slice(chunks, 1, k), lambda c: F.struct(c["rank"].alias("rank"), c["chunk_id"].alias("chunk_id"), c["score"].alias("score"), cut(F.coalesce(c["text"], F.lit(""))).alias("text_preview")))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of ids without empty ones; 1 where both are empty."""
    x, y = (F.array_distinct(F.filter(F.coalesce(v, F.array().cast("array<string>")), lambda i: i != "")) for v in (a, b))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.size(F.array_union(x, y))))


def interesting(questions: DataFrame, a: DataFrame, b: DataFrame, epsilon: float, delta: float, only: DataFrame | None = None) -> DataFrame:
    """Questions that run b retrieves better by ``epsilon`` of NDCG while its F1 gains ``delta`` at most, the greatest gain first.

    questions: question_id; runs: question_id, ndcg, f1, chunk_ids. A run that lacks a question counts 0. only: question_id, where given.
    """
    asked = questions if only is None else questions.join(only.select("question_id").distinct(), "question_id", "left_semi")
    side = lambda run, s: run.select("question_id", *[F.col(c).alias(f"{c}_{s}") for c in ("ndcg", "f1", "chunk_ids")])
    both = asked.join(side(a, "a"), "question_id", "left").join(side(b, "b"), "question_id", "left").fillna(0.0, ["ndcg_a", "f1_a", "ndcg_b", "f1_b"])
    both = both.withColumns({"delta_ndcg": F.col("ndcg_b") - F.col("ndcg_a"), "delta_f1": F.col("f1_b") - F.col("f1_a"), "overlap": overlap(F.col("chunk_ids_a"), F.col("chunk_ids_b"))})
    return both.where((F.col("delta_ndcg") >= epsilon) & (F.col("f1_b") <= F.col("f1_a") + delta)).orderBy(F.desc("delta_ndcg"), "delta_f1", "question_id")


def skipped(questions: DataFrame, only: DataFrame | None = None, **artifacts: DataFrame) -> DataFrame:
    """One row: joined questions, those outside ``only``, and those that each artifact lacks."""
    q = questions.select("question_id").distinct()
    kept = q if only is None else q.join(only.select("question_id").distinct(), "question_id", "left_semi")
    for name, df in artifacts.items():
        kept = kept.join(df.select("question_id").distinct().withColumn(name, F.lit(1)), "question_id", "left")
    counts = kept.agg(F.count(F.lit(1)).alias("joined"), *[F.count_if(F.col(n).isNull()).alias(f"missing_{n}") for n in artifacts])
    return counts.crossJoin(F.broadcast(q.agg(F.count(F.lit(1)).alias("all")))).withColumn("restricted", F.col("all") - F.col("joined")).drop("all")  # one row each


def evaluated(questions: DataFrame, retrieval: DataFrame, answers: DataFrame) -> DataFrame:
    """Every question that any of the three has: without retrieval its status is EMPTY, without an answer its prediction ''."""
    ids = questions.select("question_id").union(retrieval.select("question_id")).union(answers.select("question_id")).distinct()
    out = ids.join(questions, "question_id", "left").join(retrieval, "question_id", "left").join(answers, "question_id", "left")
    return out.withColumns({"status": F.coalesce("status", F.lit("EMPTY")), "prediction": F.coalesce("prediction", F.lit(""))})


# The multipliers and shifts of the splitmix64 generator.
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), ((30, np.uint64(0xBF58476D1CE4E5B9)), (27, np.uint64(0x94D049BB133111EB)))


def _poisson(marks: np.ndarray, samples: int, seed: int, cuts: np.ndarray) -> np.ndarray:
    """A Poisson(1) number for each mark and sample, which depends on nothing but mark, sample and seed."""
    z = marks[:, None] + (np.arange(1, samples + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(samples)) * _STEP
    for shift, factor in _MIX:
        z = (z ^ (z >> np.uint64(shift))) * factor
    z ^= z >> np.uint64(31)
    return np.searchsorted(cuts, z.ravel(), side="right").reshape(z.shape)


def bootstrap(values: DataFrame, key: str, value: str, row_id: str, samples: int = 10_000, seed: int = 42) -> DataFrame:
    """key, n, mean, low, high: the mean's 95 % interval over ``samples`` resamplings. Rows whose value is null or NaN take no part.

    Each row weighs a Poisson(1) number of times in each resampling, so that partitions resample for themselves and only their sums meet: a partition
    sends one row of ``samples`` sums a key, whatever its size. A row's draws follow from its key and ``row_id`` (unique within the key), so the
    layout of the rows decides nothing but the order in which doubles are added.
    """
    cuts = np.array([min(int(c * 2**64), 2**64 - 1) for c in np.cumsum([math.exp(-1) / math.factorial(k) for k in range(17)])], dtype=np.uint64)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for batch in batches:
            for k, rows in batch.groupby("k", dropna=False, sort=False):
                k = None if pd.isna(k) else k
                v, marks = rows["v"].to_numpy(), rows["h"].to_numpy().view(np.uint64)
                a, b, n, s = total.get(k, (np.zeros(samples), np.zeros(samples), 0, 0.0))
                for at in range(0, len(v), 64):
                    w = _poisson(marks[at : at + 64], samples, seed, cuts)
                    a, b = a + v[at : at + 64] @ w, b + w.sum(axis=0)
                total[k] = (a, b, n + len(v), s + v.sum())
        yield pd.DataFrame([(k, a.tolist(), b.tolist(), n, s) for k, (a, b, n, s) in total.items()], columns=["k", "top", "bottom", "n", "s"])

    kind = values.schema[key].dataType.simpleString()
    rows = values.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"), F.xxhash64(key, row_id).alias("h")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    parts = rows.mapInPandas(sums, f"k {kind}, top array<double>, bottom array<double>, n bigint, s double")
    each = parts.select("k", F.posexplode(F.arrays_zip("top", "bottom")).alias("at", "x"))
    drawn = each.groupBy("k", "at").agg((F.sum("x.top") / F.nullif(F.sum("x.bottom"), F.lit(0.0))).alias("mean"))
    totals = parts.groupBy("k").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"))
    bounds = drawn.groupBy("k").agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))
    return totals.join(bounds, totals["k"].eqNullSafe(bounds["k"])).select(totals["k"].alias(key), "n", "mean", "low", "high")


def flat(curve: Column, value: float, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Whether every score is about ``value``; an empty curve is flat at 0 only."""
    near = F.forall(curve, lambda x: F.abs(x - value) <= (1e-15 if value == 0 else atol + rtol * abs(value)))
    return F.when(F.size(curve) == 0, F.lit(value == 0)).otherwise(near)


def interior_peak(curve: Column, grid: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Whether the best score stands at a weight that is neither 0 nor 1."""
    inside = lambda w: (F.abs(w) > atol) & (F.abs(w - 1) > atol + rtol)
    return (F.size(curve) == F.size(grid)) & F.exists(curves.tied(curve, rtol, atol), lambda i: inside(F.get(grid, i)))


def curve_heatmap(rows: DataFrame, split: str = "all", mid_band: bool = False, interior: bool = False, drop_zero: bool = True, drop_one: bool = True) -> DataFrame:
    """column, question_id, centroid, oracle_curve of the curves that pass, ordered by centroid, then id: the matrix of the heat map.

    rows: question_id, split, oracle_curve, weight_grid.
    """
    c, g = F.col("oracle_curve"), F.col("weight_grid")
    fit = rows if split == "all" else rows.where(F.col("split") == split)
    for on, test in ((drop_zero, ~flat(c, 0.0)), (drop_one, ~flat(c, 1.0)), (interior, interior_peak(c, g)), (mid_band, curves.mid_band_wins(c, g))):
        fit = fit.where(test) if on else fit
    return fit.select("question_id", curves.centroid(c, g).alias("centroid"), c.alias("oracle_curve")).orderBy("centroid", "question_id")


def prediction_scatter(rows: DataFrame) -> DataFrame:
    """question_id, predicted_weight, distance, hit: predictions against the intervals of best weights. rows: question_id, predicted_weight, oracle_curve, weight_grid."""
    r = curves.intervals(F.col("oracle_curve"), F.col("weight_grid"))
    return rows.select("question_id", "predicted_weight", curves.distance(F.col("predicted_weight"), r).alias("distance"), curves.hits(F.col("predicted_weight"), r).alias("hit"))


def prediction_summary(rows: DataFrame) -> DataFrame:
    """n, mae, rmse, hit_share of prediction_scatter."""
    d = F.col("distance")
    return prediction_scatter(rows).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.col("hit").cast("double")).alias("hit_share"))


def prediction_intervals(rows: DataFrame) -> DataFrame:
    """question_id, midpoint, intervals, predicted_weight, hit, ordered by midpoint, then id."""
    r = curves.intervals(F.col("oracle_curve"), F.col("weight_grid"))
    return rows.select("question_id", curves.mean_midpoint(r).alias("midpoint"), r.alias("intervals"), "predicted_weight", curves.hits(F.col("predicted_weight"), r).alias("hit")).orderBy("midpoint", "question_id")


def best_weights(rows: DataFrame) -> DataFrame:
    """weight, single, tied: how many questions have a best weight there, alone or among others. rows: oracle_curve, weight_grid."""
    bins = curves.tied(F.col("oracle_curve"))
    each = rows.select(F.size(bins).alias("n"), "weight_grid", F.explode(bins).alias("b")).select(F.get("weight_grid", F.col("b")).alias("weight"), "n")
    return each.groupBy("weight").agg(F.count_if(F.col("n") == 1).alias("single"), F.count_if(F.col("n") > 1).alias("tied"))


#: Tables behind the figures, by kind.
FIGURES: dict[str, Callable[..., DataFrame]] = {
    "benchmark_oracle_heatmap": curve_heatmap,
    "oracle_argmax_weight_histogram": best_weights,
    "router_pred_vs_oracle": prediction_scatter,
    "router_pred_vs_oracle_intervals": prediction_intervals,
}


def figure(kind: str, rows: DataFrame, **options) -> DataFrame:
    """The table behind a figure of ``kind``."""
    if kind not in FIGURES:
        raise ValueError(f"unknown figure: {kind}; known: {', '.join(sorted(FIGURES))}")
    return FIGURES[kind](rows, **options)


def figures(rows: DataFrame, specs: list[dict], only: set[str] | None = None) -> dict[str, DataFrame]:
    """Tables of a list of specs (kind, name and options), those of ``only`` where given."""
    return {s.get("name", s["kind"]): figure(s["kind"], rows, **{k: v for k, v in s.items() if k not in ("kind", "name")}) for s in specs if only is None or s["kind"] in only}


def routed(dense: DataFrame, graph: DataFrame, decisions: DataFrame, keep: int = 20, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Fused lists by each question's own weight: ``keep`` ranks before truncation, and the first ``k`` of them.

    decisions: question_id, dense_weight, run_dense, run_graph. A branch that isn't run adds nothing.
    """
    ran = lambda hits, flag: hits.join(decisions.where(flag).select("question_id"), "question_id", "left_semi")
    both = ranking.align(ran(dense, "run_dense"), ran(graph, "run_graph")).join(decisions.select("question_id", "dense_weight"), "question_id")
    score = F.round(F.col("dense_weight") * F.col("dense_norm") + (1 - F.col("dense_weight")) * F.col("graph_norm"), 6)
    full = ranking.top_k(both.withColumn("score", score), keep)
    return full, full.where(F.col("rank") < k)
