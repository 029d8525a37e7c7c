"""Queries over stored dictionaries; tests hold them against a plain scan and against ``phrase_matches``."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from fusemill.checkpoint import shared_folder
from fusemill.operators import automaton
from fusemill.registry import register
from fusemill.sources.tables import table


def _folder(spark):
    return f"{shared_folder(spark)}/tries-{uuid4().hex}"


def _openings(spark, sf_dir):
    opening = F.array_join(F.slice(F.split(F.lower("text"), r"\s+"), 1, 3), " ")
    d = table(spark, sf_dir, "benchmark").select(opening.alias("match_key"), F.col("item_id").cast("string").alias("canonical"), F.lit(1).alias("df"), F.lit(1).alias("prio"))
    return d.union(table(spark, sf_dir, "nation").select(F.lower("n_name"), F.col("n_name"), F.lit(1), F.lit(0)))


@register("automaton_matches")
def automaton_matches(spark, sf_dir):
    """Openings of three words of the benchmark passages and names of nations in all documents, by a stored automaton: the rows of ``phrase_matches`` without its shuffles."""
    path = automaton.stored(_openings(spark, sf_dir), _folder(spark))
    return automaton.matches(table(spark, sf_dir, "documents").withColumn("text", F.lower("text")), path, "doc_id", "text").withColumnRenamed("id", "doc_id")


@register(
    "titles_in_order",
    """WITH said AS (SELECT l_orderkey, n_name, r_regionkey, {'line': l_linenumber, 'piece': n_name || ' of ' || r_name} AS spot FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
JOIN region ON r_regionkey = n_regionkey), named AS (SELECT l_orderkey, n_name AS title, {'spot': spot, 'side': 0} AS place FROM said UNION ALL SELECT l_orderkey, n.n_name, {'spot': spot, 'side': 1} FROM said JOIN nation n ON n.n_nationkey = r_regionkey)
SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY min(place)) AS INT) AS rank, title FROM named GROUP BY l_orderkey, title""",
)
def titles_in_order(spark, sf_dir):
    """Nations that the text of an order names, by their first occurrence; a region's name is an alias of the nation of its number. Spark writes the texts from all line items."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    of = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws(" of ", "n_name", "r_name").alias("piece"))
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(of, F.col("s_nationkey") == F.col("n_nationkey"))
    said = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "piece"))).alias("ps"))
    texts = said.select("l_orderkey", F.array_join(F.transform("ps", lambda p: p["piece"]), "; ").alias("text"))
    alias = region.join(nation, F.col("n_nationkey") == F.col("r_regionkey")).select(F.col("r_name").alias("alias"), F.col("n_name").alias("canonical"))
    path = automaton.stored(automaton.title_dictionary(nation.select(F.col("n_name").alias("title")), alias), _folder(spark))
    return automaton.titles_in_order(texts, path, "l_orderkey").withColumnRenamed("id", "l_orderkey")
