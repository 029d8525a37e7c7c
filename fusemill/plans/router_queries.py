"""Queries over the router's table, its balance and the seeds of a graph query."""

from __future__ import annotations

from pyspark.sql import functions as F

from fusemill.operators import entities
from fusemill.plans.run_queries import _TOKENS
from fusemill.registry import register
from fusemill.router import dataset
from fusemill.sources.tables import table


@register(
    "router_table",
    f"""WITH {_TOKENS}, i AS (SELECT conv_id || ':' || turn AS question_id, 's' || conv_id % 3 AS source, conv_id, len(c)::DOUBLE AS n_content FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256(question_id || ':7'), question_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM i),
e AS (SELECT *, [n * 0.7 / 1.0, n * 0.15 / 1.0, n * 0.15 / 1.0] AS want FROM r), f AS (SELECT *, list_transform(want, lambda x: floor(x + 1e-9)) AS whole FROM e),
p AS (SELECT *, list_transform(want, lambda x, j: round(x - whole[j], 9)) AS part, n - list_sum(whole) AS rest FROM f),
z AS (SELECT *, whole[1] + CASE WHEN (part[2] >= part[1])::INT + (part[3] >= part[1])::INT < rest THEN 1 ELSE 0 END AS train, whole[2] + CASE WHEN (part[1] > part[2])::INT + (part[3] >= part[2])::INT < rest THEN 1 ELSE 0 END AS dev FROM p),
s AS (SELECT *, CASE WHEN k <= train THEN 'train' WHEN k <= train + dev THEN 'dev' ELSE 'test' END AS split FROM z), fit AS (SELECT avg(n_content) AS m, stddev_samp(n_content) AS sd FROM s WHERE split = 'train')
SELECT question_id, source, split, n_content AS tokens, round((n_content - m) / CASE WHEN sd < 1e-8 THEN 1.0 ELSE sd END, 6) AS z_tokens, conv_id % 2 AS target, conv_id IN (SELECT vec_id FROM embeddings) AS has_vector FROM s, fit""",
)
def router_table(spark, sf_dir):
    """Questions are what users say; a conversation's number gives source, label (given twice, the last counts) and vector."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user'")
    items = asked.select(F.concat_ws(":", "conv_id", "turn").alias("question_id"), F.col("text").alias("question"), F.concat(F.lit(" S"), F.col("conv_id") % 3).alias("dataset_source"), "conv_id")
    labels = items.select("question_id", F.lit(-1).cast("long").alias("target"), F.lit(0).alias("pos")).union(items.select("question_id", F.col("conv_id") % 2, F.lit(1)))
    vectors = items.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("conv_id"), F.col("embedding").alias("query_embedding")), "conv_id").select("question_id", "query_embedding")
    out, _ = dataset.training_table(items.drop("conv_id"), labels, vectors)
    return out.select(
        "question_id", F.col("dataset_source").alias("source"), "split", F.col("feature_raw__content_token_len").alias("tokens"), F.round("feature_norm__content_token_len", 6).alias("z_tokens"), "target", F.col("query_embedding").isNotNull().alias("has_vector")
    )


@register(
    "train_balance",
    """WITH g AS (SELECT o_orderkey, CAST(least(o_orderkey % 9, 4) AS INT) AS band FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY sha256(o_orderkey || ':42'), o_orderkey) AS k FROM g),
m AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM g GROUP BY band)) SELECT o_orderkey, band FROM r, m WHERE k <= least""",
)
def train_balance(spark, sf_dir):
    """As many orders of each of five bands as the smallest has; the last band holds five ninths of all."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.least(F.col("o_orderkey") % 9, F.lit(4)).cast("int").alias("band"))
    return dataset.balance_groups(o, "band", "o_orderkey")


_NODES = "length(p_type) % 2 = 0"
_BRANDS = "p_partkey % 3 > 0"


@register(
    "seed_nodes",
    f"""WITH c AS (SELECT DISTINCT l_orderkey AS question_id, p_type AS canonical FROM lineitem JOIN part ON p_partkey = l_partkey), n AS (SELECT p_type AS node FROM part WHERE {_NODES} UNION SELECT p_brand FROM part WHERE {_BRANDS}),
b AS (SELECT p_type AS canonical, max({{'score': p_retailprice, 'matched': p_brand}}) AS b FROM part WHERE p_brand IN (SELECT node FROM n) GROUP BY 1)
SELECT question_id, CASE WHEN node IS NULL THEN coalesce(b.matched, canonical) ELSE canonical END AS canonical, CASE WHEN node IS NULL THEN b.score END AS vector_score, node IS NOT NULL OR b IS NOT NULL AS graph_present, coalesce(node, b.matched) AS node
FROM c LEFT JOIN n ON node = canonical LEFT JOIN b USING (canonical)""",
)
def seed_nodes(spark, sf_dir):
    """Types of an order's parts as candidates: their own node, else the best-scored brand that the graph has."""
    p = table(spark, sf_dir, "part")
    named = table(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("question_id"), F.col("p_type").alias("canonical")).distinct()
    nodes = p.where(_NODES).select(F.col("p_type").alias("entity")).union(p.where(_BRANDS).select("p_brand"))
    near = p.select(F.col("p_type").alias("canonical"), F.col("p_brand").alias("matched"), F.col("p_retailprice").alias("score"))
    return entities.enrich_seeds(named, nodes, near)
