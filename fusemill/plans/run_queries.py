"""Router, comparison and figure queries over the driver's tables: parts stand for questions with a curve each, customers for questions of two runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fusemill.functions import articles, batch
from fusemill.operators import compare, curves
from fusemill.registry import register
from fusemill.router import dataset, training
from fusemill.sources import artifacts
from fusemill.sources.tables import table

_SPLITS = """m AS (SELECT doc_id, source, sha256(doc_id || ':7') AS mark FROM documents),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY mark, doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM m),
s AS (SELECT *, floor(n * 0.7 + 1e-9) AS a, floor(n * 0.15 + 1e-9) AS b, round(n * 0.7 - floor(n * 0.7 + 1e-9), 9) AS fa, round(n * 0.15 - floor(n * 0.15 + 1e-9), 9) AS fb FROM r),
z AS (SELECT *, n - a - 2 * b AS rest FROM s),
q AS (SELECT *, a + CASE WHEN (CASE WHEN fb >= fa THEN 2 ELSE 0 END) < rest THEN 1 ELSE 0 END AS train, b + CASE WHEN 1 + (CASE WHEN fa > fb THEN 1 ELSE 0 END) < rest THEN 1 ELSE 0 END AS dev FROM z)"""


@register("split_stratified", f"WITH {_SPLITS} SELECT doc_id, source, CASE WHEN k <= train THEN 'train' WHEN k <= train + dev THEN 'dev' ELSE 'test' END AS split FROM q")
def split_stratified(spark, sf_dir):
    """Largest remainders; of the equal ones of dev and test, test goes first."""
    return dataset.assign_splits(table(spark, sf_dir, "documents"), "doc_id", "source")


@register(
    "balance_mask",
    """WITH v AS (SELECT l.doc_id, d.source, row_number() OVER (PARTITION BY d.source ORDER BY sha256(l.doc_id || ':42'), l.doc_id) AS r FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.quality = 1),
m AS (SELECT min(n) AS least FROM (SELECT source, count(*) AS n FROM v GROUP BY source)) SELECT doc_id, source, 'balance' AS reason FROM v, m WHERE r > least""",
)
def balance_mask(spark, sf_dir):
    """Documents of good quality beyond as many as the smallest source has; ranks are counted in ranges of the hash."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    marked = good.withColumn("mark", F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":42")), 256))
    least = good.groupBy("source").count().agg(F.min("count").alias("least"))  # one row
    ranked = dataset.rank_by_hash(marked, ["source"], "mark", "doc_id").crossJoin(F.broadcast(least))
    return ranked.where("k > least").select("doc_id", "source", F.lit("balance").alias("reason"))


_TOKENS = r"""t AS (SELECT conv_id, turn, trim(coalesce(text, '')) AS q FROM conversations WHERE role = 'user'),
w AS (SELECT *, list_filter(regexp_extract_all(lower(q), '[\p{L}\p{N}]+(?:[''’][\p{L}]+)?%?'), lambda x: NOT list_contains(__STOPS__, x)) AS c FROM t)""".replace("__STOPS__", str(dataset.QUESTION_STOP_WORDS))
_CUES = str(dataset.RELATION_CUES)


@register(
    "query_features",
    f"WITH {_TOKENS} SELECT conv_id, turn, len(c)::DOUBLE AS content_token_len, len(regexp_extract_all(q, '\"[^\"]+\"|''[^'']+'''))::DOUBLE AS quoted_span_count, "
    f"round(len(list_filter(c, lambda x: list_contains({_CUES}, x))) / greatest(len(c), 1)::DOUBLE, 6) AS relation_cue_density, "
    + r"(regexp_matches(lower(q), '\b(?:__WORDS__)\b') OR regexp_matches(q, '\b(?:19|20)\d{2}\b'))::INT::DOUBLE AS temporal_indicator FROM w".replace("__WORDS__", "|".join(dataset.TEMPORAL_WORDS + dataset.MONTHS)),
)
def query_features(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", dataset.query_features(F.col("text")).alias("f"))
    return rows.select("conv_id", "turn", "f.content_token_len", "f.quoted_span_count", F.round("f.relation_cue_density", 6).alias("relation_cue_density"), "f.temporal_indicator")


# a curve of five scores a part, in sevenths
_CURVES = "cv AS (SELECT p_partkey, [0.0, 0.25, 0.5, 0.75, 1.0] AS g, list_transform(range(5), lambda k: ((p_partkey * (k + 1) + k) % 7) / 7.0::DOUBLE) AS c, (p_partkey % 11) / 10.0 AS w FROM part WHERE p_partkey % 7 <> 6)"


def _curved(spark, sf_dir):
    key = F.col("p_partkey")
    curve = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.pmod(key * (k + 1) + k, F.lit(7)).cast("double") / 7)
    grid = F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])
    rows = table(spark, sf_dir, "part").where("p_partkey % 7 <> 6")
    return rows.select(key.alias("question_id"), F.lit("test").alias("split"), curve.alias("oracle_curve"), grid.alias("weight_grid"), ((key % 11).cast("double") / 10).alias("predicted_weight"), F.lit(True).alias("valid"))


_LEAN = "round(list_sum(list_transform(range(1, 6), lambda k: c[k] * g[k])) / list_sum(c), 6)"


@register("curve_heatmap", f"WITH {_CURVES} SELECT p_partkey AS question_id, {_LEAN} AS centroid FROM cv WHERE greatest(c[2], c[3], c[4]) > greatest(c[1], c[5])")
def curve_heatmap(spark, sf_dir):
    found = compare.curve_heatmap(_curved(spark, sf_dir), mid_band=True)
    return found.select("question_id", F.round("centroid", 6).alias("centroid"))


_NEAR = """tb AS (SELECT p_partkey, w, g, list_transform(c, lambda x: abs(x - list_max(c)) <= 1e-8 + 1e-5 * list_max(c)) AS tie FROM cv),
ds AS (SELECT p_partkey, w, list_min(list_transform(range(1, 6), lambda k: CASE WHEN NOT tie[k] THEN 9.0 WHEN k < 5 AND tie[least(k + 1, 5)] THEN greatest(g[k] - w, w - g[least(k + 1, 5)], 0.0) ELSE abs(w - g[k]) END)) AS d FROM tb)"""


@register("prediction_scatter", f"WITH {_CURVES}, {_NEAR} SELECT p_partkey AS question_id, w::DOUBLE AS predicted_weight, round(d, 6) AS distance, d < 1e-12 AS hit FROM ds")
def prediction_scatter(spark, sf_dir):
    return compare.prediction_scatter(_curved(spark, sf_dir)).withColumn("distance", F.round("distance", 6))


@register("prediction_summary", f"WITH {_CURVES}, {_NEAR} SELECT count(*) AS n, round(avg(d), 6) AS mae, round(sqrt(avg(d * d)), 6) AS rmse, round(avg((d < 1e-12)::INT), 6) AS hit_share FROM ds")
def prediction_summary(spark, sf_dir):
    s = compare.prediction_summary(_curved(spark, sf_dir))
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "hit_share")])


@register("best_weights", f"WITH {_CURVES}, {_NEAR} SELECT g[k] AS weight, count(*) FILTER (n = 1) AS single, count(*) FILTER (n > 1) AS tied FROM (SELECT g, tie, len(list_filter(tie, lambda x: x)) AS n, unnest(range(1, 6)) AS k FROM tb) WHERE tie[k] GROUP BY 1")
def best_weights(spark, sf_dir):
    return compare.best_weights(_curved(spark, sf_dir))


@register(
    "router_metrics",
    f"WITH {_CURVES}, {_NEAR}, rg AS (SELECT p_partkey, list_max(c) AS best, list_max(c) - CASE WHEN w * 4 >= 4 THEN c[5] ELSE c[floor(w * 4)::INT + 1] + (w * 4 - floor(w * 4)) * (c[floor(w * 4)::INT + 2] - c[floor(w * 4)::INT + 1]) END AS r FROM (SELECT p_partkey, c, least(w, 1.0) AS w FROM cv)) "
    "SELECT 'test' AS split, count(*) AS n, round(avg(r), 6) AS mean_regret, round(avg(r) / avg(best), 6) AS normalised_regret, round(avg(d), 6) AS mae FROM rg JOIN ds USING (p_partkey)",
)
def router_metrics(spark, sf_dir):
    out = training.metrics(_curved(spark, sf_dir))
    return out.select("split", "n", *[F.round(c, 6).alias(c) for c in ("mean_regret", "normalised_regret", "mae")])


@register("interior_peaks", f"WITH {_CURVES} SELECT p_partkey AS question_id FROM cv WHERE greatest(c[2], c[3], c[4]) >= list_max(c) - 1e-8")
def interior_peaks(spark, sf_dir):
    rows = _curved(spark, sf_dir)
    return rows.where(compare.interior_peak(F.col("oracle_curve"), F.col("weight_grid")) & (F.size(curves.tied(F.col("oracle_curve"))) > 0)).select("question_id")


_RUNS = """q AS (SELECT c_custkey AS k, (c_custkey % 10) / 10.0 AS na, (c_custkey % 7) / 7.0 AS fa, CASE WHEN c_custkey % 11 = 0 THEN 0.0 ELSE ((c_custkey * 3) % 10) / 10.0 END AS nb, CASE WHEN c_custkey % 11 = 0 THEN 0.0 ELSE ((c_custkey + 2) % 7) / 7.0 END AS fb,
  ['c' || c_nationkey, 'x'] AS ca, CASE WHEN c_custkey % 11 = 0 THEN [] ELSE ['c' || (c_custkey % 25), 'x', ''] END AS cb FROM customer)"""


def _runs(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    share = lambda v, n: F.pmod(v, F.lit(n)).cast("double") / n
    chunk = lambda v: F.concat(F.lit("c"), v.cast("string"))
    a = c.select(k.alias("question_id"), share(k, 10).alias("ndcg"), share(k, 7).alias("f1"), F.array(chunk(F.col("c_nationkey")), F.lit("x")).alias("chunk_ids"))
    b = c.where("c_custkey % 11 <> 0").select(k.alias("question_id"), share(k * 3, 10).alias("ndcg"), share(k + 2, 7).alias("f1"), F.array(chunk(k % 25), F.lit("x"), F.lit("")).alias("chunk_ids"))
    return c.select(k.alias("question_id")), a, b


@register(
    "interesting_questions",
    f"WITH {_RUNS} SELECT k AS question_id, round(nb - na, 6) AS delta_ndcg, round(fb - fa, 6) AS delta_f1, round(len(list_intersect(ca, list_filter(cb, lambda x: x <> ''))) / len(list_distinct(list_concat(ca, list_filter(cb, lambda x: x <> ''))))::DOUBLE, 6) AS overlap FROM q WHERE round(nb - na, 9) >= 0.15 AND round(fb - fa, 9) <= 0.1",
)
def interesting_questions(spark, sf_dir):
    found = compare.interesting(*_runs(spark, sf_dir), epsilon=0.15, delta=0.1)
    return found.select("question_id", *[F.round(c, 6).alias(c) for c in ("delta_ndcg", "delta_f1", "overlap")])


@register("skipped_questions", "SELECT count(*) AS joined, 0::BIGINT AS missing_a, count(*) FILTER (c_custkey % 11 = 0) AS missing_b, 0::BIGINT AS restricted FROM customer")
def skipped_questions(spark, sf_dir):
    q, a, b = _runs(spark, sf_dir)
    return compare.skipped(q, a=a, b=b)


@register("numbered_rows", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_id FROM orders")
def numbered_rows(spark, sf_dir):
    """Row ids of a whole table without one task that holds it."""
    return artifacts.numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").select("o_orderkey", "row_id")


@register(
    "generation_parse",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS answer, CASE WHEN event_id % 5 = 0 THEN 'non_200_response' WHEN event_id % 3 = 0 THEN 'missing required field: reasoning' END AS error FROM events""",
)
def generation_parse(spark, sf_dir):
    """Batch responses made of events, read back."""
    reason = F.when(F.col("event_id") % 3 == 0, "").otherwise(', \\"reasoning\\": \\"r\\"')
    args = F.concat(F.lit('{\\"answer\\": \\" '), F.col("event_type"), F.lit('\\"'), reason, F.lit("}"))
    status = F.when(F.col("event_id") % 5 == 0, "500").otherwise("200")
    line = F.concat(F.lit('{"custom_id": "x", "response": {"status_code": '), status, F.lit(', "body": {"choices": [{"message": {"tool_calls": [{"function": {"name": "format_answer", "arguments": "'), args, F.lit('"}}]}}]}}}'))
    return table(spark, sf_dir, "events").select("event_id", batch.generation(line).alias("g")).select("event_id", "g.answer", "g.error")


@register("answer_contexts", "SELECT o_custkey, string_agg('order ' || o_orderkey, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY o_orderkey) AS context FROM orders GROUP BY 1")
def answer_contexts(spark, sf_dir):
    chunk = F.struct("o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("text"))
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(chunk)).alias("x"))
    return g.select("o_custkey", F.array_join(batch.contexts(F.col("x")), batch.CONTEXT_SEPARATOR).alias("context"))


@register("latency_bootstrap")
def latency_bootstrap(spark, sf_dir):
    """The mean's 95 % interval for each event type over 10,000 resamplings, by Poisson weights inside the partitions."""
    out = compare.bootstrap(table(spark, sf_dir, "events"), "event_type", "value", "event_id")
    return out.select("event_type", "n", *[F.round(c, 4).alias(c) for c in ("mean", "low", "high")])


@register("router_train")
def router_train(spark, sf_dir):
    """A linear router on the first eight numbers of each vector: metrics of each split after ten steps."""
    v = table(spark, sf_dir, "embeddings")
    x = F.transform(F.slice("embedding", 1, 8), lambda y: y.cast("double"))
    up = x[0] > 0
    curve = F.when(up, F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.5), F.lit(0.0)))
    split = F.when(F.col("vec_id") % 10 < 7, "train").when(F.col("vec_id") % 10 == 7, "dev").otherwise("test")
    rows = v.select(F.col("vec_id").alias("question_id"), split.alias("split"), F.col("label").cast("string").alias("dataset_source"), x.alias("x"), curve.alias("oracle_curve"), F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0)).alias("weight_grid"), up.cast("int").alias("target"), F.lit(True).alias("valid"))
    fit = training.train(rows, 8, 0, "linear", epochs=10, rate=0.3)
    out = training.metrics(training.predictions(fit, rows))
    return out.select("split", "n", *[F.round(c, 4).alias(c) for c in ("mean_regret", "mae")])


@register("article_blocks")
def article_blocks(spark, sf_dir):
    """Headings, paragraphs and lists of every page, with their section."""
    each = table(spark, sf_dir, "pages").select("page_id", F.posexplode(articles.blocks(F.col("html"))).alias("pos", "b"))
    return each.select("page_id", "pos", F.array_join("b.section_path", " / ").alias("section"), "b.block_type", "b.text")
