"""Queries over the keyed store."""

from __future__ import annotations

from pyspark.sql import functions as F

from fusemill.registry import register
from fusemill.sources.store import Store
from fusemill.sources.tables import table


@register(
    "store_get_or_fetch",
    """SELECT d.doc_id, md5(coalesce(d.text, '')) AS text_md5, CASE WHEN l.doc_id IS NULL THEN 'fetched' WHEN l.toxic = 1 THEN 'replaced' ELSE 'stored' END AS origin
FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id)""",
)
def store_get_or_fetch(spark, sf_dir):
    """A store of the labelled documents, in which toxic ones are put anew; then all documents are asked for, and the missing ones come from the table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    store = Store(spark, "doc_id BIGINT, text STRING, origin STRING", "doc_id", int(spark.conf.get("spark.sql.shuffle.partitions")))
    store.put(docs.join(labels, "doc_id", "left_semi").withColumn("origin", F.lit("stored")))
    store.put(docs.join(labels.where("toxic = 1"), "doc_id", "left_semi").withColumn("origin", F.lit("replaced")))
    out = store.get_or_fetch(docs.select("doc_id"), lambda keys: docs.join(keys, "doc_id", "left_semi").withColumn("origin", F.lit("fetched")))
    return out.select("doc_id", F.md5("text").alias("text_md5"), "origin")
