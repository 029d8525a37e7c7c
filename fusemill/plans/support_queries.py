"""Support-sentence queries: words of a passage as tokens, its sentences as candidates, its third word as the answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from fusemill.functions import text
from fusemill.operators import support
from fusemill.registry import register
from fusemill.sources.tables import table

_STOP = "[" + ", ".join(f"'{w}'" for w in support.STOP_WORDS) + "]"
_TERMS = r"list_filter(list_distinct(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')), lambda t: length(t) > 1 AND NOT list_contains(" + _STOP + ", t))"
_FORM = r"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower({x}), '|', ' '), '\s+([,.;:!?%])', '\1', 'g'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@register("keyword_terms", f"SELECT doc_id, len({_TERMS.format(x='text')}) AS n_terms, sha256(array_to_string(list_sort({_TERMS.format(x='text')}), ' ')) AS terms_hash FROM documents")
def keyword_terms(spark, sf_dir):
    terms = table(spark, sf_dir, "documents").select("doc_id", support.keyword_terms(F.col("text")).alias("t"))
    return terms.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.sha2(F.array_join(F.sort_array("t"), " "), 256).alias("terms_hash"))


def _visible(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("tokens"))
    return support.visible_tokens(words.withColumn("is_html", F.transform("tokens", lambda t: F.contains(t, F.lit(".")))), "doc_id")


_VISIBLE = """WITH w AS (SELECT doc_id, string_split(text, ' ') AS ts FROM documents), e AS (SELECT doc_id, unnest(ts) AS raw, generate_subscripts(ts, 1) - 1 AS i FROM w),
s AS (SELECT doc_id, i, trim(raw) AS token FROM e WHERE NOT contains(raw, '.') AND trim(raw) <> ''),
v AS (SELECT doc_id, i, token, sum(length(token) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS e_ FROM s)
"""


@register("visible_offsets", _VISIBLE + "SELECT doc_id, count(*) AS n_visible, CAST(max(e_) AS BIGINT) AS n_chars, CAST(sum(i * 31 + e_ - length(token)) AS BIGINT) AS checksum FROM v GROUP BY 1")
def visible_offsets(spark, sf_dir):
    v = _visible(spark, sf_dir).withColumnRenamed("id", "doc_id")
    return v.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_visible"), F.max("end").cast("long").alias("n_chars"), F.sum(F.col("i") * 31 + F.col("start")).cast("long").alias("checksum"))


@register("span_offsets", _VISIBLE + 'SELECT doc_id, min(i) AS first, max(i) AS last, CAST(min(e_ - length(token)) AS BIGINT) AS start, CAST(max(e_) AS BIGINT) AS "end" FROM v WHERE i BETWEEN 3 AND 9 GROUP BY 1')
def span_offsets(spark, sf_dir):
    spans = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(3).alias("first_token"), F.lit(9).alias("last_token"))
    return support.span_offsets(_visible(spark, sf_dir), spans).withColumnRenamed("id", "doc_id")


@register(
    "best_sentence",
    rf"""WITH b AS (SELECT item_id, text, {_TERMS.format(x='text')} AS ctx, {_FORM.format(x="split_part(text, ' ', 3)")} AS ans, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM benchmark),
c AS (SELECT *, {_TERMS.format(x='trim(ss[1])')} AS qt, trim(unnest(ss)) AS s, generate_subscripts(ss, 1) AS k FROM b),
r AS (SELECT item_id, s, len(list_intersect({_TERMS.format(x='s')}, ctx)) AS c_, len(list_intersect({_TERMS.format(x='s')}, qt)) AS q_, length(s) AS n, k FROM c WHERE s <> '' AND ans <> '' AND contains({_FORM.format(x='s')}, ans))
SELECT item_id, s AS sentence FROM r QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY c_ DESC, q_ DESC, n, k) = 1""",
)
def best_sentence(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", "text", text.sentences(F.col("text")).alias("ss"))
    found = support.best_sentence(F.col("ss"), F.array(F.split_part("text", F.lit(" "), F.lit(3))), support.keyword_terms(F.col("text")), support.keyword_terms(F.get("ss", F.lit(0))))
    return b.select("item_id", found.alias("sentence")).where("sentence IS NOT NULL")
