"""Vector search, ranked lists, fusion, weight sweeps and ranking metrics.

A ranked list is a long table (question_id, chunk_id, score); order is score descending, then id.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fusemill.functions.text import contains_normalized, matching_form

QUERY_LIMIT = 10_000
#: Corpus rows of a group that meets a block of QUERY_LIMIT queries, and pairs that are looked at together in it.
CORPUS_ROWS, PAIRS = 8192, 1 << 21


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def cosine_of(a: Column, b: Column, length_a: Column, length_b: Column) -> Column:
    """The same where the lengths are known."""
    return F.coalesce(F.try_divide(dot(a, b), length_a * length_b), F.lit(0.0))


def rank(hits: DataFrame, *keys: str) -> DataFrame:
    """Add rank from 0: score descending, then chunk_id."""
    w = Window.partitionBy(*(keys or ("question_id",))).orderBy(F.desc("score"), F.col("chunk_id"))
    return hits.withColumn("rank", F.row_number().over(w) - 1)


def top_k(hits: DataFrame, k: int, *keys: str) -> DataFrame:
    """Ranks below k. The row_number filter plans a partial limit before the shuffle."""
    if k <= 0:
        raise ValueError("k must be positive")
    return rank(hits, *keys).where(F.col("rank") < k)


def checked_broadcast(queries: DataFrame) -> DataFrame:
    """Broadcast ``queries`` while they are at most QUERY_LIMIT rows, which is counted; leave more to Spark's own choice."""
    return F.broadcast(queries) if queries.limit(QUERY_LIMIT + 1).count() <= QUERY_LIMIT else queries


def _regular(name: str, vec: str, size: int) -> Column:
    """Rows with an id and ``size`` finite components."""
    return F.coalesce(F.col(name).isNotNull() & (F.size(vec) == size) & F.forall(vec, lambda x: F.abs(x.cast("double")) < float("inf")), F.lit(False))


def _rounded(x: np.ndarray) -> np.ndarray:
    """To 6 places, halves away from zero, as Spark rounds: near a half by the number's decimal digits."""
    scaled = np.abs(x) * 1e6
    out = np.copysign(np.floor(scaled + 0.5), x) / 1e6
    for k in np.flatnonzero((np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6 + scaled * 1e-14) | (scaled > 1e9)):
        out[k] = float(Decimal(repr(float(x[k]))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) if abs(x[k]) < 1e20 else x[k]
    return out


def _best(queries: np.ndarray, vectors: np.ndarray, k: int, threshold: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, vector row and score of the k best vectors of each query: rounded scores, then the earlier row.

    A matrix product tells which vectors may be among them, with room for rounding; their scores are summed one component after the other.
    """
    k = min(k, len(vectors))
    length = np.sqrt((vectors * vectors).sum(axis=1).max())
    found = []
    step = max(1, PAIRS // len(vectors))
    for low in range(0, len(queries), step):
        part = queries[low : low + step]
        near = part @ vectors.T
        room = 2e-6 + 1e-12 * length * np.sqrt((part * part).sum(axis=1))
        least = np.partition(near, len(vectors) - k, axis=1)[:, len(vectors) - k] - room
        if threshold is not None:
            least = np.maximum(least, threshold - room)
        asked, met = np.nonzero(~(near < least[:, None]))
        score = np.zeros(len(asked))
        for at in range(0, len(asked), PAIRS // 32):
            here = slice(at, at + PAIRS // 32)
            x, y = part[asked[here]], vectors[met[here]]
            for c in range(vectors.shape[1]):
                score[here] += x[:, c] * y[:, c]
        rounded = _rounded(score)
        if threshold is not None:
            fit = rounded >= threshold
            asked, met, score, rounded = asked[fit], met[fit], score[fit], rounded[fit]
        order = np.lexsort((met, -rounded, asked))
        asked = asked[order]
        first = np.arange(len(asked)) - np.searchsorted(asked, asked) < k
        found.append((asked[first] + low, met[order][first], score[order][first]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _block_search(queries: DataFrame, corpus: DataFrame, n_queries: int, n_corpus: int, k: int, threshold: float | None) -> DataFrame:
    """question_id, chunk_id, score (not rounded): the k best of every group of the corpus for every query, all vectors regular."""
    blocks, parts = -(-n_queries // QUERY_LIMIT), -(-n_corpus // CORPUS_ROWS)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("question_id", "q_vec", F.pmod(F.xxhash64("question_id"), F.lit(blocks)).cast("int").alias("_block"), every(parts).alias("_part"))
    c = corpus.select("chunk_id", "vec", F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int").alias("_part"), every(blocks).alias("_block"))

    def search(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or rows.empty:
            return pd.DataFrame({"question_id": [], "chunk_id": [], "score": []})
        rows = rows.sort_values("chunk_id", kind="stable")
        i, j, score = _best(np.stack(asked["q_vec"]).astype(np.float64), np.stack(rows["vec"]).astype(np.float64), k, threshold)
        return pd.DataFrame({"question_id": asked["question_id"].to_numpy()[i], "chunk_id": rows["chunk_id"].to_numpy()[j], "score": score})

    kinds = f"question_id {queries.schema['question_id'].dataType.simpleString()}, chunk_id {corpus.schema['chunk_id'].dataType.simpleString()}, score double"
    return q.groupBy("_block", "_part").cogroup(c.groupBy("_block", "_part")).applyInPandas(search, kinds)


def dense_search(queries: DataFrame, corpus: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """Exact inner-product top k. queries: question_id, q_vec; corpus: chunk_id, vec.

    Blocks of about QUERY_LIMIT queries meet groups of about CORPUS_ROWS rows of the corpus, each pair of a block and a group in one task of bounded size, which gives k rows a query;
    the k best of those are taken. Vectors with a null or a component that isn't finite, of another size than the queries', or without an id, are scored one by one. Scores are
    rounded to 6 places before ranking, so that engines agree on ties.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    size = queries.agg(F.max(F.size("q_vec"))).first()[0] or 0
    q, c = queries.withColumn("_fine", _regular("question_id", "q_vec", size)), corpus.withColumn("_fine", _regular("chunk_id", "vec", size))
    counts = lambda df: df.agg(F.count_if("_fine"), F.count_if(~F.col("_fine"))).first()
    (n_q, odd_q), (n_c, odd_c) = counts(q), counts(c)
    fine = lambda df: df.where("_fine").drop("_fine")
    odd = lambda df: df.where("NOT _fine").drop("_fine")
    scored = _block_search(fine(q), fine(c), max(1, n_q), max(1, n_c), k, threshold)
    one_by_one = lambda a, b: b.join(checked_broadcast(a), F.lit(True)).select("question_id", "chunk_id", dot(F.col("vec"), F.col("q_vec")).alias("score"))
    if odd_q:
        scored = scored.unionByName(one_by_one(odd(q), fine(c)))
    if odd_c:
        scored = scored.unionByName(one_by_one(queries, odd(c)))
    scored = scored.withColumn("score", F.round("score", 6))
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return top_k(scored, k)


def min_max(hits: DataFrame, *keys: str) -> DataFrame:
    """Add norm: the score on its list's own range; 1.0 where all scores are equal."""
    w = Window.partitionBy(*(keys or ("question_id",)))
    low, high = F.min("score").over(w), F.max("score").over(w)
    return hits.withColumn("norm", F.when(high == low, 1.0).otherwise(F.try_divide(F.col("score") - low, high - low)))


def align(dense: DataFrame, graph: DataFrame) -> DataFrame:
    """Full outer join of two lists; a side that lacks a chunk counts 0."""
    d = min_max(dense).select("question_id", "chunk_id", F.col("score").alias("dense_score"), F.col("norm").alias("dense_norm"))
    g = min_max(graph).select("question_id", "chunk_id", F.col("score").alias("graph_score"), F.col("norm").alias("graph_norm"))
    return d.join(g, ["question_id", "chunk_id"], "full_outer").fillna(0.0, ["dense_norm", "graph_norm"])


def fuse(dense: DataFrame, graph: DataFrame, weight: float, k: int) -> DataFrame:
    """question_id, chunk_id, dense_norm, graph_norm, score, rank of the k best at ``weight`` for the dense list."""
    if not 0 <= weight <= 1:
        raise ValueError("weight must be within 0 and 1")
    both = align(dense, graph)
    score = F.round(weight * F.col("dense_norm") + (1 - weight) * F.col("graph_norm"), 6)
    return top_k(both.withColumn("score", score), k)


def fused_status(dense: Column, graph: Column, has_rows: Column) -> Column:
    """ERROR if both sides failed, NO_CONTEXT without rows, else OK."""
    return F.when((dense == "ERROR") & (graph == "ERROR"), "ERROR").when(~has_rows, "NO_CONTEXT").otherwise("OK")


def weight_grid(bins: int = 11) -> list[float]:
    return [round(k / (bins - 1), 6) for k in range(bins)]


def sweep(dense: DataFrame, graph: DataFrame, k: int, weights: list[float] | None = None) -> DataFrame:
    """Fused lists at every weight: question_id, bin, w, chunk_id, score, rank. Normalising stands below the expansion, once."""
    grid = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(w).alias("w")) for i, w in enumerate(weights or weight_grid())])
    both = align(dense, graph).select("*", F.explode(grid).alias("g")).select("*", "g.bin", "g.w").drop("g")
    score = F.round(F.col("w") * F.col("dense_norm") + (1 - F.col("w")) * F.col("graph_norm"), 6)
    return top_k(both.withColumn("score", score), k, "question_id", "bin")


def credit_first(ranked: DataFrame, *keys: str) -> DataFrame:
    """OR mode: of the relevant rows (``hit``) of a list only the first gets rel 1."""
    w = Window.partitionBy(*(keys or ("question_id",))).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(F.col("hit").cast("int")).over(w), F.lit(0))
    return ranked.withColumn("rel", F.when(F.col("hit") & (seen == 0), 1).otherwise(0))


def stateful_credit(contained: Column) -> Column:
    """AND mode. contained: array (in rank order) of arrays of gold numbers that a chunk contains. Each chunk credits its
    first gold that no earlier chunk has; array of 0 and 1."""
    start = F.struct(F.array().cast("array<int>").alias("done"), F.array().cast("array<int>").alias("rel"))

    def step(state: Column, golds: Column) -> Column:
        new = F.get(F.array_sort(F.array_except(golds, state["done"])), F.lit(0))
        done = F.when(new.isNull(), state["done"]).otherwise(F.array_append(state["done"], new))
        return F.struct(done.alias("done"), F.array_append(state["rel"], new.isNotNull().cast("int")).alias("rel"))

    return F.aggregate(contained, start, step, lambda s: s["rel"])


# Sources whose questions are answered by any one gold.
ANY_SOURCES = ["nq", "naturalquestions", "natural_questions"]


def any_gold(source: Column) -> Column:
    """True where one gold answers the question (OR mode); else, as for an unknown source, each gold counts (AND mode)."""
    return F.coalesce(F.lower(F.trim(source)).isin(ANY_SOURCES), F.lit(False))


def distinct_golds(golds: Column) -> Column:
    """Golds whose matching forms are new and not empty, in their order."""
    forms = F.transform(F.coalesce(golds, F.array().cast("array<string>")), lambda g: matching_form(F.coalesce(g, F.lit(""))))
    pairs = F.arrays_zip(golds.alias("g"), forms.alias("f"))
    return F.transform(F.filter(pairs, lambda p, i: (p["f"] != "") & (F.array_position(forms, p["f"]) == i + 1)), lambda p: p["g"])


def contained_golds(chunk: Column, golds: Column) -> Column:
    """Numbers (from 0) of the golds that stand in a chunk's text."""
    return F.filter(F.sequence(F.lit(0), F.size(golds) - 1), lambda k: (k >= 0) & (k < F.size(golds)) & F.coalesce(contains_normalized(chunk, F.get(golds, k)), F.lit(False)))


def credit(ranked: DataFrame, *keys: str, contained: str = "contained", any_of: str = "any_of") -> DataFrame:
    """Add rel, 0 or 1. OR mode: the first chunk with a gold; AND mode: each chunk with a gold that none before it was credited for.

    ranked: keys, rank, contained (gold numbers of the chunk), any_of (the list's mode). A list is folded in one row; it has as many ranks as were asked for.
    """
    by = list(keys or ("question_id",))
    rows = ranked.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("rank", contained))).alias("_x"), F.bool_or(any_of).alias("_any"))
    golds = F.transform("_x", lambda x: x[contained])
    first = F.array_position(F.transform(golds, lambda g: (F.size(g) > 0).cast("int")), 1)
    rel = F.when(F.col("_any"), F.transform(golds, lambda g, i: (i + 1 == first).cast("int"))).otherwise(stateful_credit(golds))
    flat = rows.select(*by, F.explode(F.zip_with("_x", rel, lambda x, r: F.struct(x["rank"].alias("rank"), r.alias("rel")))).alias("_r")).select(*by, "_r.*")
    return ranked.join(flat, [*by, "rank"])


def score_lists(chunks: DataFrame, golds: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """question_id and ndcg, hit and recall at each k, 0 for questions without a chunk or whose status isn't OK.

    chunks: question_id, rank, text; golds: question_id, dataset_source, golds, status.
    """
    asked = golds.select("question_id", any_gold(F.col("dataset_source")).alias("any_of"), distinct_golds(F.col("golds")).alias("golds"), "status")
    met = chunks.join(asked.where("status = 'OK'"), "question_id").withColumn("contained", contained_golds(F.coalesce("text", F.lit("")), F.col("golds")))
    ideal = F.when(F.col("any_of"), F.least(F.size("golds"), F.lit(1))).otherwise(F.size("golds"))
    out = suite(credit(met.select("question_id", "rank", "contained", "any_of", ideal.alias("ideal"))), F.col("ideal"), ks)
    names = [c for c in out.columns if c != "question_id"]
    return asked.select("question_id").join(out, "question_id", "left").fillna(0.0, names)


def suite(ranked: DataFrame, ideal_hits: Column, ks: tuple[int, ...] = (5, 10, 20), keys: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """ndcg, hit and recall at each k in one pass; ``rel`` is 0 or 1, ``ideal_hits`` the number of creditable golds of a list."""
    aggs = []
    for k in ks:
        inside = F.col("rank") < k
        aggs += [
            F.sum(F.when(inside, F.col("rel") / F.log2(F.col("rank") + 2)).otherwise(0.0)).alias(f"_dcg{k}"),
            F.max(F.when(inside, F.col("rel")).otherwise(0)).cast("double").alias(f"hit_{k}"),
            F.sum(F.when(inside, F.col("rel")).otherwise(0)).alias(f"_sum{k}"),
        ]
    out = ranked.groupBy(*keys).agg(*aggs, F.first(ideal_hits).alias("_m"))
    for k in ks:
        best = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("_m", F.lit(k)).cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
        out = out.withColumns(
            {
                f"ndcg_{k}": F.round(F.when(F.col("_m") > 0, F.col(f"_dcg{k}") / best).otherwise(0.0), 6),
                f"recall_{k}": F.round(F.coalesce(F.least(F.lit(1.0), F.try_divide(F.col(f"_sum{k}").cast("double"), F.col("_m").cast("double"))), F.lit(0.0)), 6),
            }
        )
    return out.drop("_m", *[f"_dcg{k}" for k in ks], *[f"_sum{k}" for k in ks])


def best_bin(scored: DataFrame) -> DataFrame:
    """question_id, bin, w, objective: greatest objective, then nearest to one half, then first bin."""
    order = F.struct("objective", -F.abs(F.col("w") - 0.5), -F.col("bin"))
    return scored.groupBy("question_id").agg(F.max_by(F.struct("bin", "w", "objective"), order).alias("b")).select("question_id", "b.*")
