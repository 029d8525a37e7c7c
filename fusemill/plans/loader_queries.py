"""Queries over the loaders and page parsers, on records and pages that Spark writes from the given tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from fusemill.checkpoint import shared_folder
from fusemill.functions import articles
from fusemill.registry import register
from fusemill.sources import benchmarks
from fusemill.sources.tables import table


def _order_records(spark, sf_dir):
    """One record an order, as a line of JSON: lines are context articles of two sentences, returned ones the supporting facts, beside a fact that no article has."""
    line = F.struct("l_linenumber", "l_partkey", "l_returnflag", F.concat_ws(" ", F.lit("Line"), F.col("l_linenumber").cast("string"), F.lit("sends"), F.col("l_partkey").cast("string")).alias("said"))
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("ls"))
    met = g.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey")
    title = lambda x: F.concat(F.lit("Line "), x["l_linenumber"].cast("string"), F.lit("/"), x["l_partkey"].cast("string"))
    back = F.filter("ls", lambda x: x["l_returnflag"] == "R")
    context = F.struct(F.transform("ls", title).alias("title"), F.transform("ls", lambda x: F.array(F.lit("Nothing. "), x["said"])).alias("sentences"))
    facts = F.struct(F.concat(F.array(F.lit("no such article")), F.transform(back, title)).alias("title"), F.concat(F.array(F.lit(0)), F.transform(back, lambda x: F.lit(1))).alias("sent_id"))
    record = F.struct(F.concat(F.lit("  what came back of order "), F.col("l_orderkey").cast("string"), F.lit(" ")).alias("question"), F.col("o_orderstatus").alias("answer"), context.alias("context"), facts.alias("supporting_facts"))
    return met.select(F.to_json(record).alias("value"))


@register(
    "multihop_items",
    """WITH said AS (SELECT l_orderkey, l_linenumber, l_partkey, 'Line ' || l_linenumber || ' sends ' || l_partkey AS s, 'Line ' || l_linenumber || '/' || l_partkey AS t FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT sha256('what came back of order ' || l_orderkey) AS question_id, min(o_orderstatus) AS answers, string_agg(s, '|' ORDER BY l_linenumber, l_partkey) AS sentences, string_agg(t, '|' ORDER BY l_linenumber, l_partkey) AS titles
FROM said JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey""",
)
def multihop_items(spark, sf_dir):
    """Benchmark items of raw multi-hop records, written as JSON lines and read by the loader: orders without a supporting sentence go."""
    path = f"{shared_folder(spark)}/records-{uuid4().hex}.jsonl"
    _order_records(spark, sf_dir).write.text(path, compression="gzip")
    items = benchmarks.load_multihop(benchmarks.read_variants(spark, path), "2wiki")
    return items.select("question_id", *[F.array_join(c, "|").alias(n) for c, n in (("gold_answers", "answers"), ("gold_support_sentences", "sentences"), ("gold_support_titles", "titles"))])


@register(
    "infobox_facts",
    """WITH s AS (SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
b AS (SELECT DISTINCT l_suppkey AS s_suppkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT s_suppkey, s_name AS subject, 'Nation' AS label, n_name AS value FROM s UNION ALL SELECT s_suppkey, s_name, 'Origin', n_name || ', ' || r_name FROM s UNION ALL SELECT s_suppkey, s_name, 'Region', r_name FROM s
UNION ALL SELECT s_suppkey, s_name, 'Brands & more', p_brand FROM s JOIN b USING (s_suppkey)""",
)
def infobox_facts(spark, sf_dir):
    """Facts of pages that Spark writes for all suppliers: links, an origin of several links, spans, and a list of the brands they sent."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name", "r_name")
    sent = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey").alias("s_suppkey")).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    pages = s.join(sent.groupBy("s_suppkey").agg(F.collect_set("p_brand").alias("brands")), "s_suppkey", "left")
    row = lambda label, *cell: [F.lit(f'<tr><th class="infobox-label">{label}</th><td class="infobox-data">'), *cell, F.lit("</td></tr>")]
    link = lambda c: F.concat(F.lit("<a>"), F.col(c), F.lit("</a>"))
    items = F.array_join(F.transform(F.coalesce("brands", F.array().cast("array<string>")), lambda x: F.concat(F.lit("<li>"), x, F.lit("</li>"))), "")
    html = F.concat(
        F.lit('<p>Before.</p><table><tr><th class="infobox-label">No</th><td class="infobox-data"><a>box</a></td></tr></table><table class="wide infobox"><tr><th>Title only</th></tr>'),
        *row("Nation", link("n_name")), *row("Origin", F.lit('<div class="birthplace">'), link("n_name"), F.lit(" and "), link("r_name"), F.lit("</div>")),
        *row("Region", F.lit("<span>"), F.col("r_name"), F.lit("</span><span></span>")), *row("Brands &amp; more", F.lit("<ul>"), items, F.lit("</ul>")), F.lit("</table>"),
    )
    return pages.select("s_suppkey", F.explode(articles.infobox_facts(html, F.col("s_name"))).alias("f")).select("s_suppkey", "f.*")
