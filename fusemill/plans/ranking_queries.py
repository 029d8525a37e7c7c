"""Search, fusion, sweep, metric and curve queries over ``embeddings``: vectors whose id is divisible by 100 ask, all vectors are the corpus.

The second branch ranks by the cosine to the centroid of the question's label; a chunk is relevant if it has the question's label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fusemill import checkpoint
from fusemill.operators import curves, quantiles, ranking
from fusemill.registry import register
from fusemill.sources.tables import table

K = 20

# The same branches in SQL, for the oracles.
_BRANCHES = """
q AS (SELECT vec_id AS question_id, embedding::DOUBLE[] AS v, label AS q_label FROM embeddings WHERE vec_id % 100 = 0),
c AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS v, label FROM embeddings),
d0 AS (SELECT question_id, chunk_id, round(list_inner_product(c.v, q.v), 6) AS score FROM q, c),
dense AS (SELECT question_id, chunk_id, score FROM d0 QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) <= 20),
ctr AS (SELECT label, list(m ORDER BY pos) AS v FROM (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM c) GROUP BY 1, 2) GROUP BY 1),
g0 AS (SELECT question_id, chunk_id, round(list_cosine_similarity(c.v, ctr.v), 6) AS score FROM q JOIN ctr ON ctr.label = q.q_label, c),
graph AS (SELECT question_id, chunk_id, score FROM g0 QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) <= 20)"""
_NORM = """
dn AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm FROM dense WINDOW w AS (PARTITION BY question_id)),
gn AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm FROM graph WINDOW w AS (PARTITION BY question_id)),
al AS (SELECT coalesce(dn.question_id, gn.question_id) AS question_id, coalesce(dn.chunk_id, gn.chunk_id) AS chunk_id, coalesce(dn.norm, 0.0) AS dense_norm, coalesce(gn.norm, 0.0) AS graph_norm
       FROM dn FULL JOIN gn ON dn.question_id = gn.question_id AND dn.chunk_id = gn.chunk_id)"""
_SWEEP = """
grid AS (SELECT CAST(i AS INT) AS bin, round(i / 10.0, 6)::DOUBLE AS w FROM range(11) t(i)),
f0 AS (SELECT question_id, chunk_id, bin, w, round(w * dense_norm + (1 - w) * graph_norm, 6) AS score FROM al, grid),
fz AS (SELECT *, row_number() OVER (PARTITION BY question_id, bin ORDER BY score DESC, chunk_id) - 1 AS rank FROM f0),
rel AS (SELECT fz.question_id, fz.bin, fz.w, fz.rank, (c.label = q.q_label)::INT AS rel FROM fz JOIN q USING (question_id) JOIN c USING (chunk_id) WHERE rank < 20),
ideal AS (SELECT sum(1 / log2(i + 2)) AS best FROM range(10) t(i)),
scored AS (SELECT question_id, bin, w, round(sum(CASE WHEN rank < 10 THEN rel / log2(rank + 2) ELSE 0.0 END) / any_value(best), 6) AS objective FROM rel, ideal GROUP BY 1, 2, 3)"""
_CURVES = """
cv AS (SELECT question_id, list(objective ORDER BY bin) AS curve, list(w ORDER BY bin) AS grid FROM scored GROUP BY 1),
pt AS (SELECT question_id, bin, w, objective AS s, max(objective) OVER (PARTITION BY question_id) AS top FROM scored),
tie AS (SELECT *, bin - row_number() OVER (PARTITION BY question_id ORDER BY bin) AS island FROM pt WHERE abs(s - top) <= 1e-8 + 1e-5 * abs(top)),
iv AS (SELECT question_id, min(w) AS lo, max(w) AS hi FROM tie GROUP BY question_id, island),
pred AS (SELECT question_id, ((question_id * 7) % 11) / 10.0 AS w_hat FROM q)"""


def _sql(*parts: str, select: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("q_vec"), F.col("label").alias("q_label"))
    return q, e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"), "label")


def branches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """queries, corpus, dense list, second list."""
    q, c = _sides(spark, sf_dir)
    dense = ranking.dense_search(q.drop("q_label"), c.drop("label"), K).drop("rank")
    parts = c.select("label", F.posexplode("vec").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centers = parts.groupBy(F.col("label").alias("q_label")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias("center"))
    # a chunk's score is the same for all questions of a label, so lists are made once a label
    asked = ranking.checked_broadcast(centers.join(q.select("q_label"), "q_label", "left_semi"))
    cosine = ranking.cosine_of(F.col("vec"), F.col("center"), F.col("length"), F.col("center_length"))
    sized = c.select("chunk_id", "vec", F.sqrt(ranking.dot(F.col("vec"), F.col("vec"))).alias("length"))
    asked = asked.withColumn("center_length", F.sqrt(ranking.dot(F.col("center"), F.col("center"))))
    scored = sized.join(asked, F.lit(True)).select("q_label", "chunk_id", F.round(cosine, 6).alias("score"))
    lists = ranking.top_k(scored, K, "q_label").drop("rank")
    return q, c, dense, q.select("question_id", "q_label").join(lists, "q_label").select("question_id", "chunk_id", "score")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, bin, w, objective: NDCG@10 of the fused list at each weight."""
    q, c, dense, graph = branches(spark, sf_dir)
    fused = ranking.sweep(dense, graph, K)
    rel = fused.join(q.select("question_id", "q_label"), "question_id").join(c.select("chunk_id", "label"), "chunk_id")
    rel = rel.withColumn("rel", (F.col("label") == F.col("q_label")).cast("int"))
    out = ranking.suite(rel, F.lit(K), (10,), ("question_id", "bin", "w"))
    return out.select("question_id", "bin", "w", F.col("ndcg_10").alias("objective"))


def _curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = F.sort_array(F.collect_list(F.struct("bin", "objective", "w")))
    out = _scored(spark, sf_dir).groupBy("question_id").agg(points.alias("p"))
    return out.select(
        "question_id",
        F.transform("p", lambda x: x["objective"]).alias("curve"),
        F.transform("p", lambda x: x["w"]).alias("grid"),
        ((F.col("question_id") * 7) % 11 / F.lit(10.0)).alias("w_hat"),
    )


@register("dense_topk", _sql(_BRANCHES, select="SELECT question_id, chunk_id, score, (row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) - 1)::INT AS rank FROM dense"))
def dense_topk(spark, sf_dir):
    q, c = _sides(spark, sf_dir)
    return ranking.dense_search(q.drop("q_label"), c.drop("label"), K)


@register("dense_threshold", _sql(_BRANCHES, select="SELECT question_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS r FROM d0 WHERE score >= 0.25) WHERE r <= 5"))
def dense_threshold(spark, sf_dir):
    q, c = _sides(spark, sf_dir)
    return ranking.dense_search(q.drop("q_label"), c.drop("label"), 5, threshold=0.25).drop("rank")


@register("minmax_norm", _sql(_BRANCHES, _NORM, select="SELECT question_id, chunk_id, round(norm, 6) AS norm FROM dn"))
def minmax_norm(spark, sf_dir):
    q, c = _sides(spark, sf_dir)
    hits = ranking.dense_search(q.drop("q_label"), c.drop("label"), K)
    return ranking.min_max(hits).select("question_id", "chunk_id", F.round("norm", 6).alias("norm"))


def _fuse_sql(w: float) -> str:
    return _sql(
        _BRANCHES, _NORM,
        select=f"SELECT question_id, chunk_id, score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) - 1)::INT AS rank FROM (SELECT question_id, chunk_id, round({w} * dense_norm + {round(1 - w, 6)} * graph_norm, 6) AS score FROM al)) WHERE rank < 10",
    )


@register("fuse_50_50", _fuse_sql(0.5))
def fuse_50_50(spark, sf_dir):
    _, _, dense, graph = branches(spark, sf_dir)
    return ranking.fuse(dense, graph, 0.5, 10).select("question_id", "chunk_id", "score", "rank")


@register("fuse_weighted", _fuse_sql(0.75))
def fuse_weighted(spark, sf_dir):
    _, _, dense, graph = branches(spark, sf_dir)
    return ranking.fuse(dense, graph, 0.75, 10).select("question_id", "chunk_id", "score", "rank")


@register(
    "ndcg_suite",
    _sql(
        _BRANCHES,
        """r AS (SELECT d.question_id, row_number() OVER (PARTITION BY d.question_id ORDER BY d.score DESC, d.chunk_id) - 1 AS rank, (c.label = q.q_label)::INT AS hit FROM dense d JOIN q USING (question_id) JOIN c USING (chunk_id)),
cr AS (SELECT *, CASE WHEN hit = 1 AND coalesce(max(hit) OVER (PARTITION BY question_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 THEN 1 ELSE 0 END AS rel FROM r)""",
        select="SELECT question_id, "
        + ", ".join(
            f"round(sum(CASE WHEN rank < {k} THEN rel / log2(rank + 2) ELSE 0.0 END), 6) AS ndcg_{k}, max(CASE WHEN rank < {k} THEN rel ELSE 0 END)::DOUBLE AS hit_{k}, round(least(1.0, sum(CASE WHEN rank < {k} THEN rel ELSE 0 END)::DOUBLE), 6) AS recall_{k}"
            for k in (5, 10, 20)
        )
        + " FROM cr GROUP BY 1",
    ),
)
def ndcg_suite(spark, sf_dir):
    q, c = _sides(spark, sf_dir)
    hits = ranking.dense_search(q.drop("q_label"), c.drop("label"), K)
    rel = hits.join(q.drop("q_vec"), "question_id").join(c.drop("vec"), "chunk_id").withColumn("hit", F.col("label") == F.col("q_label"))
    return ranking.suite(ranking.credit_first(rel), F.lit(1))


@register(
    "ndcg_and",
    _sql(
        _BRANCHES,
        """r AS (SELECT d.question_id, row_number() OVER (PARTITION BY d.question_id ORDER BY d.score DESC, d.chunk_id) - 1 AS rank, (c.label - q.q_label + 10) % 10 AS gold FROM dense d JOIN q USING (question_id) JOIN c USING (chunk_id)),
cr AS (SELECT *, CASE WHEN gold < 3 AND row_number() OVER (PARTITION BY question_id, gold ORDER BY rank) = 1 THEN 1 ELSE 0 END AS rel FROM r)""",
        select="SELECT question_id, "
        + ", ".join(
            f"round(sum(CASE WHEN rank < {k} THEN rel / log2(rank + 2) ELSE 0.0 END) / (1 + 1 / log2(3) + 0.5), 6) AS ndcg_{k}, max(CASE WHEN rank < {k} THEN rel ELSE 0 END)::DOUBLE AS hit_{k}, round(least(1.0, sum(CASE WHEN rank < {k} THEN rel ELSE 0 END)::DOUBLE / 3), 6) AS recall_{k}"
            for k in (5, 10, 20)
        )
        + " FROM cr GROUP BY 1",
    ),
)
def ndcg_and(spark, sf_dir):
    """Three golds a question: chunks of its label and of the two after it; each is credited once."""
    q, c = _sides(spark, sf_dir)
    hits = ranking.dense_search(q.drop("q_label"), c.drop("label"), K)
    gold = F.pmod(F.col("label") - F.col("q_label"), F.lit(10))
    met = hits.join(q.drop("q_vec"), "question_id").join(c.drop("vec"), "chunk_id").withColumn("contained", F.when(gold < 3, F.array(gold.cast("int"))).otherwise(F.array().cast("array<int>")))
    return ranking.suite(ranking.credit(met.withColumn("any_of", F.lit(False))), F.lit(3))


@register("oracle_sweep", _sql(_BRANCHES, _NORM, _SWEEP, select="SELECT question_id, bin, w, objective FROM scored"))
def oracle_sweep(spark, sf_dir):
    return _scored(spark, sf_dir)


@register(
    "oracle_best_bin",
    _sql(_BRANCHES, _NORM, _SWEEP, select="SELECT question_id, bin, w, objective FROM scored QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY objective DESC, abs(w - 0.5), bin) = 1"),
)
def oracle_best_bin(spark, sf_dir):
    return ranking.best_bin(_scored(spark, sf_dir))


@register("oracle_upper_bound", _sql(_BRANCHES, _NORM, _SWEEP, select="SELECT round(avg(m), 6) AS mean_best, count(*) AS questions FROM (SELECT question_id, max(objective) AS m FROM scored GROUP BY 1)"))
def oracle_upper_bound(spark, sf_dir):
    best = ranking.best_bin(_scored(spark, sf_dir))
    return best.agg(F.round(F.avg("objective"), 6).alias("mean_best"), F.count(F.lit(1)).alias("questions"))


@register("curve_intervals", _sql(_BRANCHES, _NORM, _SWEEP, _CURVES, select="SELECT question_id, lo, hi FROM iv"))
def curve_intervals(spark, sf_dir):
    return _curves(spark, sf_dir).select("question_id", F.inline(curves.intervals(F.col("curve"), F.col("grid"))))


@register(
    "interval_distance",
    _sql(
        _BRANCHES, _NORM, _SWEEP, _CURVES,
        select="SELECT question_id, round(min(greatest(lo - w_hat, w_hat - hi, 0.0)), 6) AS distance, bool_or(w_hat >= lo - 1e-15 AND w_hat <= hi + 1e-15) AS hit, round(avg((lo + hi) / 2), 6) AS midpoint FROM iv JOIN pred USING (question_id) GROUP BY 1",
    ),
)
def interval_distance(spark, sf_dir):
    c = _curves(spark, sf_dir).withColumn("iv", curves.intervals(F.col("curve"), F.col("grid")))
    return c.select(
        "question_id",
        F.round(curves.distance(F.col("w_hat"), F.col("iv")), 6).alias("distance"),
        curves.hits(F.col("w_hat"), F.col("iv")).alias("hit"),
        F.round(curves.mean_midpoint(F.col("iv")), 6).alias("midpoint"),
    )


_REGRET = """
rg AS (SELECT question_id, list_max(curve) AS top, w_hat, curve, least(floor(w_hat * 10)::INT, 10) AS lo, w_hat * 10 - least(floor(w_hat * 10)::INT, 10) AS part FROM cv JOIN pred USING (question_id)),
rr AS (SELECT question_id, top - (curve[lo + 1] + part * (curve[least(lo + 1, 10) + 1] - curve[lo + 1])) AS regret, curve FROM rg)"""


@register("regret", _sql(_BRANCHES, _NORM, _SWEEP, _CURVES, _REGRET, select="SELECT question_id, round(regret, 6) AS regret, round(pow(greatest(regret - 0.05, 0), 2), 6) AS hinge FROM rr"))
def regret(spark, sf_dir):
    c, w = F.col("curve"), F.col("w_hat")
    return _curves(spark, sf_dir).select("question_id", F.round(curves.regret(c, w), 6).alias("regret"), F.round(curves.hinge_squared(c, w, 0.05), 6).alias("hinge"))


@register(
    "regret_quartiles",
    _sql(
        _BRANCHES, _NORM, _SWEEP, _CURVES, _REGRET,
        """sd AS (SELECT *, round(list_stddev_pop(curve), 9) AS sd FROM rr),
cut AS (SELECT quantile_cont(sd, 0.25) AS a, quantile_cont(sd, 0.5) AS b, quantile_cont(sd, 0.75) AS c FROM sd)""",
        select="SELECT (CASE WHEN sd <= a THEN 1 WHEN sd <= b THEN 2 WHEN sd <= c THEN 3 ELSE 4 END)::INT AS quartile, count(*) AS n, round(avg(regret), 6) AS mean_regret FROM sd, cut GROUP BY 1",
    ),
)
def regret_quartiles(spark, sf_dir):
    c = _curves(spark, sf_dir).select(F.round(curves.spread(F.col("curve")), 9).alias("sd"), curves.regret(F.col("curve"), F.col("w_hat")).alias("regret"))
    c = checkpoint.cut(c)  # both searches run once
    cut = quantiles.exact(c, [], F.col("sd"), [0.25, 0.5, 0.75]).select(F.col("quantiles").alias("p"))
    s, p = F.col("sd"), F.col("p")
    quartile = F.when(s <= p[0], 1).when(s <= p[1], 2).when(s <= p[2], 3).otherwise(4)
    return c.join(F.broadcast(cut), F.lit(True)).groupBy(quartile.alias("quartile")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("regret"), 6).alias("mean_regret"))


@register("curve_centroid", _sql(_BRANCHES, _NORM, _SWEEP, select="SELECT question_id, round(CASE WHEN sum(objective) > 0 THEN sum(objective * w) / sum(objective) ELSE min(w) END, 6) AS centroid FROM scored GROUP BY 1"))
def curve_centroid(spark, sf_dir):
    return _curves(spark, sf_dir).select("question_id", F.round(curves.centroid(F.col("curve"), F.col("grid")), 6).alias("centroid"))


@register(
    "mid_band_filter",
    _sql(
        _BRANCHES, _NORM, _SWEEP,
        select="SELECT question_id FROM scored GROUP BY 1 HAVING max(CASE WHEN bin BETWEEN 2 AND 8 THEN objective END) > max(CASE WHEN bin < 2 THEN objective END) AND max(CASE WHEN bin BETWEEN 2 AND 8 THEN objective END) > max(CASE WHEN bin > 8 THEN objective END)",
    ),
)
def mid_band_filter(spark, sf_dir):
    return _curves(spark, sf_dir).where(curves.mid_band_wins(F.col("curve"), F.col("grid"))).select("question_id")


@register(
    "plateau_midpoint",
    _sql(
        _BRANCHES, _NORM, _SWEEP, _CURVES,
        """fst AS (SELECT question_id, min(bin) AS f FROM pt WHERE s = top GROUP BY 1),
edge AS (SELECT pt.question_id, coalesce(max(CASE WHEN s < top - 0.02 AND bin < f THEN bin END) + 1, 0) AS l, coalesce(min(CASE WHEN s < top - 0.02 AND bin > f THEN bin END) - 1, 10) AS r FROM pt JOIN fst USING (question_id) GROUP BY 1)""",
        select="SELECT question_id, round((l + r) / 20.0, 6) AS midpoint, least(4, floor((l + r) / 4.0 + 1e-9))::INT AS bucket FROM edge",
    ),
)
def plateau_midpoint(spark, sf_dir):
    mid = curves.plateau_midpoint(F.col("curve"), F.col("grid"), 0.02)
    out = _curves(spark, sf_dir).select("question_id", F.round(mid, 6).alias("midpoint"))
    return out.withColumn("bucket", curves.group_of(F.col("midpoint")))


@register(
    "weight_histogram",
    _sql(_BRANCHES, _NORM, _SWEEP, _CURVES, select="SELECT bin, (n > 1) AS is_tie, count(*) AS questions FROM (SELECT bin, count(*) OVER (PARTITION BY question_id) AS n FROM tie) GROUP BY 1, 2"),
)
def weight_histogram(spark, sf_dir):
    t = _curves(spark, sf_dir).withColumn("t", curves.tied(F.col("curve")))
    return t.select(F.explode("t").alias("bin"), (F.size("t") > 1).alias("is_tie")).groupBy("bin", "is_tie").agg(F.count(F.lit(1)).alias("questions"))


@register(
    "router_labels",
    _sql(_BRANCHES, _NORM, _SWEEP, _CURVES, select="SELECT question_id, list_max(curve) AS best, round(list_stddev_pop(curve), 6) AS spread, list_max(curve) > 0 AS valid, (CASE WHEN curve[11] >= curve[1] THEN 'dense' ELSE 'graph' END) AS branch FROM cv"),
)
def router_labels(spark, sf_dir):
    c = F.col("curve")
    return _curves(spark, sf_dir).select(
        "question_id",
        F.array_max(c).alias("best"),
        F.round(curves.spread(c), 6).alias("spread"),
        (F.array_max(c) > 0).alias("valid"),
        F.when(F.element_at(c, -1) >= F.get(c, F.lit(0)), "dense").otherwise("graph").alias("branch"),
    )


@register(
    "jaccard_runs",
    _sql(
        _BRANCHES,
        "j AS (SELECT question_id, list(DISTINCT d.chunk_id) AS a, (SELECT list(DISTINCT g.chunk_id) FROM graph g WHERE g.question_id = d.question_id) AS b FROM dense d GROUP BY 1)",
        select="SELECT question_id, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE, 6) AS jaccard FROM j",
    ),
)
def jaccard_runs(spark, sf_dir):
    _, _, dense, graph = branches(spark, sf_dir)
    a = dense.groupBy("question_id").agg(F.collect_set("chunk_id").alias("a"))
    b = graph.groupBy("question_id").agg(F.collect_set("chunk_id").alias("b"))
    both = a.join(b, "question_id", "full_outer")
    share = F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))
    return both.select("question_id", F.round(F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(share), 6).alias("jaccard"))
