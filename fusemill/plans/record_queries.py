"""Queries over model records: routing, latency, verdicts, triples and phrases."""

from __future__ import annotations

from pyspark.sql import functions as F

from fusemill.functions import records
from fusemill.operators import entities, extraction, phrases
from fusemill.registry import register
from fusemill.sources.tables import table

_POLICIES = ["50-50", "dense-only", "graph-only", "learned-soft", "hard-routing", "hybrid"]


@register(
    "routing_policies",
    """WITH p AS (SELECT event_id, user_id, value / 100 AS w, (user_id % 2)::INT AS cls, 0.5 + (event_id % 50) / 100.0 AS conf FROM events),
x AS (SELECT *, unnest(['50-50', 'dense-only', 'graph-only', 'learned-soft', 'hard-routing', 'hybrid']) AS policy FROM p),
d AS (SELECT *, policy = 'hybrid' AND conf < 0.7 AS low FROM x),
r AS (SELECT *, CASE policy WHEN '50-50' THEN 0.5 WHEN 'dense-only' THEN 1.0 WHEN 'graph-only' THEN 0.0 WHEN 'learned-soft' THEN greatest(0.0, least(1.0, w))
ELSE CASE WHEN low THEN 0.4 WHEN cls = 1 THEN 1.0 ELSE 0.0 END END::DOUBLE AS dw FROM d WHERE policy <> 'learned-soft' OR w IS NOT NULL)
SELECT policy, count(*) AS n, round(avg(dw), 6) AS dense_weight, count(*) FILTER (policy IN ('50-50', 'learned-soft') OR low OR dw = 1) AS dense_runs,
count(*) FILTER (policy IN ('50-50', 'learned-soft') OR low OR dw = 0) AS graph_runs, count(*) FILTER (low) AS fallbacks FROM r GROUP BY policy""",
)
def routing_policies(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 100).alias("w"), (F.col("user_id") % 2).alias("cls"), (0.5 + (F.col("event_id") % 50) / 100).alias("conf"))
    x = e.withColumn("policy", F.explode(F.array(*[F.lit(p) for p in _POLICIES])))
    d = x.select("policy", records.route(F.col("policy"), F.col("w"), F.col("cls"), F.col("conf"), 0.7, 0.4).alias("d")).where("d IS NOT NULL").select("policy", "d.*")
    return d.groupBy("policy").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("dense_weight"), 6).alias("dense_weight"), F.count_if("run_dense").alias("dense_runs"), F.count_if("run_graph").alias("graph_runs"), F.count_if("fallback").alias("fallbacks")
    )


@register(
    "latency_canonical",
    """WITH e AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'dense' WHEN 'error' THEN 'graph' ELSE 'fusion' END AS r, coalesce(value, 0.0) AS v FROM events)
SELECT event_id, CASE WHEN r <> 'graph' THEN round(v, 4) END AS dense_branch_ms, CASE WHEN r = 'graph' THEN round(v, 4) END AS graph_branch_ms, CASE WHEN r = 'fusion' THEN 0.0 END AS fusion_ms,
round(v + 2, 4) AS retrieval_stage_total_ms FROM e""",
)
def latency_canonical(spark, sf_dir):
    r = F.when(F.col("event_type") == "click", "Dense ").when(F.col("event_type") == "error", "graph").otherwise("fusion")
    v = F.col("value").cast("string")
    raw = F.create_map(F.lit("total"), v, F.lit("dense_total"), v, F.lit("fusion"), F.lit("none"))
    m = table(spark, sf_dir, "events").select("event_id", records.latency(r, raw, F.lit(2.0)).alias("m"))
    return m.select("event_id", *[F.round(F.col("m")[k], 4).alias(k) for k in ("dense_branch_ms", "graph_branch_ms", "fusion_ms", "retrieval_stage_total_ms")])


@register("judge_verdicts", "SELECT doc_id, CASE WHEN toxic = 1 THEN NULL ELSE quality = 1 END AS correct FROM labels")
def judge_verdicts(spark, sf_dir):
    said = F.to_json(F.struct((F.col("quality") == 1).alias("correct")))
    body = F.struct(F.array(F.struct(F.struct(said.alias("content")).alias("message"))).alias("choices"))
    line = F.to_json(F.struct(F.struct(F.when(F.col("toxic") == 1, 500).otherwise(200).alias("status_code"), body.alias("body")).alias("response")))
    return table(spark, sf_dir, "labels").select("doc_id", records.verdict(line).alias("correct"))


def _triples(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    said = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    raw = p.select(F.col("p_size").alias("chunk_id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("subj_surface"), F.lower("p_type").alias("pred"), F.col("p_brand").alias("obj_surface"), F.lit(None).cast("double").alias("confidence"), F.col("p_type").alias("evidence"), said.alias("text"))
    return extraction.clean_triples(raw)


_TRIPLES = """WITH t AS (SELECT p_size AS chunk_id, p_partkey AS pos, p_name AS subj_surface, p_brand AS obj_surface, lower(p_type) AS pred, lower(p_name) AS subj_norm, trim(regexp_replace(lower(p_brand), '\\W+', ' ', 'g')) AS obj_norm,
length(p_name) + 1 AS start_char, length(p_name) + 1 + length(p_type) AS end_char FROM part), k AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY chunk_id, subj_norm, pred, obj_norm ORDER BY pos) = 1)
"""


@register("triples_clean", _TRIPLES + "SELECT chunk_id, pos, subj_norm, pred, obj_norm, 0.8::DOUBLE AS confidence, start_char, end_char FROM k")
def triples_clean(spark, sf_dir):
    return _triples(spark, sf_dir).select("chunk_id", "pos", "subj_norm", "pred", "obj_norm", "confidence", "start_char", "end_char")


@register(
    "triple_entities",
    _TRIPLES + "SELECT chunk_id, norm, arg_min(surface, pos * 2 + side) AS surface FROM (SELECT chunk_id, pos, 0 AS side, subj_norm AS norm, subj_surface AS surface FROM k UNION ALL SELECT chunk_id, pos, 1, obj_norm, obj_surface FROM k) GROUP BY 1, 2",
)
def triple_entities(spark, sf_dir):
    return extraction.endpoints(_triples(spark, sf_dir))


@register("phrase_matches")
def phrase_matches(spark, sf_dir):
    """Openings of three words of the benchmark passages and names of nations, found in all documents; tests hold the operator against a plain scan."""
    opening = F.array_join(F.slice(F.split(F.lower("text"), r"\s+"), 1, 3), " ")
    d = table(spark, sf_dir, "benchmark").select(opening.alias("match_key"), F.col("item_id").cast("string").alias("canonical"), F.lit(1).alias("df"), F.lit(1).alias("prio"))
    d = d.union(table(spark, sf_dir, "nation").select(F.lower("n_name"), F.col("n_name"), F.lit(1), F.lit(0)))
    return phrases.matches(table(spark, sf_dir, "documents").withColumn("text", F.lower("text")), d, "doc_id", "text").withColumnRenamed("id", "doc_id")


@register("question_entities")
def question_entities(spark, sf_dir):
    """Phrases of the benchmark passages and names of nations that documents name, filtered, resolved by aliases and ranked."""
    opening = F.array_join(F.slice(F.split(F.lower("text"), r"\s+"), 1, 3), " ")
    d = table(spark, sf_dir, "benchmark").select(opening.alias("match_key"), opening.alias("canonical"), F.lit(1).alias("df"), F.lit(2).alias("prio"))
    nations = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("match_key"), F.lower("n_name").alias("canonical"), F.lit(1).alias("df"), F.lit(3).alias("prio"))
    regions = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    alias = entities.aliases(regions.select(F.col("n_name").alias("alias"), F.col("r_name").alias("canonical"), F.col("n_nationkey").cast("string").alias("pos")))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    out = entities.extract(docs, d.union(nations), alias)
    return out.select(F.col("id").alias("doc_id"), "rank", "canonical", "matched", "start", "end", "n_tokens")
