"""Queries of the contract over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fusemill.llm import ann, bpe, chat, hard_negatives, html_text, importance, license_scan, line_dedup, mixing, quality_rules, simhash, token_counts, weak_quality
from fusemill.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_OP4_SQL = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT *, string_split(text, chr(10)) AS raw, list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM t),
u AS (SELECT row_number() OVER () AS rid, * FROM l),
e AS (SELECT rid, unnest(g) AS gram, generate_subscripts(g, 1) AS i FROM u),
rep AS (SELECT rid, i FROM e QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n_repeat FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
x AS (SELECT u.rid, doc_id, text, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda y: length(y))), 0)::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  list_filter(raw, lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS full_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, raw FROM u LEFT JOIN cov USING (rid)),
b AS (SELECT *, (len(full_lines) - len(list_distinct(full_lines)))::BIGINT AS n_dup_lines, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM x),
ln AS (SELECT rid, unnest(raw) AS y, generate_subscripts(raw, 1) AS no FROM b),
fl AS (SELECT rid, y, no, (length(y) < 200 AND ((regexp_matches(y, '^\s*\S+(\s+\S+){0,2}\s*$') AND NOT regexp_matches(y, __TERMINAL__)) OR regexp_matches(y, __BOILERPLATE__)))
  OR (regexp_matches(y, '[#*$%&|<>»›•·]|!!') AND (
      len(regexp_extract_all(' ' || regexp_replace(y, '(\s)', '\1\1', 'g') || ' ', '\s[|»›•·]\s')) >= 3
      OR len(regexp_extract_all(y, '[#*$%&|<>]')) * 10 > length(y)
      OR (len(regexp_extract_all(y, '!!')) >= 3 AND len(regexp_extract_all(y, '!!')) * 3 >= len(regexp_extract_all(y, '\S+'))))) AS fails FROM ln),
ls AS (SELECT rid, sum(length(y)) - coalesce(sum(length(y)) FILTER (NOT fails AND (first_of OR NOT dups)), 0) AS lost_chars FROM (
  SELECT fl.*, row_number() OVER (PARTITION BY fl.rid, y ORDER BY no) = 1 AS first_of, b.n_dup_lines > 0 AS dups FROM fl JOIN b USING (rid)) GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost_chars / greatest(length(text), 1) <= 0.4 AS kept, lost_chars::BIGINT AS lost_chars,
  (lost_chars / greatest(length(text), 1))::DOUBLE AS loss FROM b JOIN ls USING (rid)"""
_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_OP4_SQL = _OP4_SQL.replace("__TERMINAL__", _quoted(quality_rules.TERMINAL)).replace("__BOILERPLATE__", _quoted(quality_rules.BOILERPLATE))

_OP8_SQL = """WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum(length(role) + length(__ESCAPED__) + 24)::BIGINT AS formatted_chars FROM t GROUP BY 1)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""
_escaped = "replace(text, '\\', '\\\\')"
for _c in chat.CONTROL:
    _escaped = f"replace({_escaped}, '{_c}', '{_c[0]}\\{_c[1:]}')"
_OP8_SQL = _OP8_SQL.replace("__ESCAPED__", _escaped).replace("+ 24)", f"+ {len(chat.START) + 1 + len(chat.END)})")

_W = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOWER = "translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP9_SQL = (
    f"WITH t AS (SELECT row_number() OVER () AS rid, doc_id, text, regexp_extract_all({_LOWER.format(x='text')}, {_W}) AS w FROM documents),\n"
    + "p(label, words) AS (VALUES "
    + ", ".join(f"('{label}', {phrase.split()})" for phrase, label in license_scan.PHRASES.items())
    + "),\ntpl(label, words) AS (VALUES "
    + ", ".join(f"('{label}', {sorted(set(words.split()))})" for label, words in license_scan.TEMPLATES)
    + """),
pl AS (SELECT rid, label, i FROM (SELECT rid, label, words, w, unnest(range(1, greatest(len(w) - len(words) + 2, 1))) AS i FROM t, p WHERE list_has_all(w, words)) WHERE list_slice(w, i, i + len(words) - 1) = words),
b AS (SELECT rid, count(*) AS n, min(i) - 1 AS f, max(i) - 1 AS l, list_distinct(list(label)) AS labels FROM pl GROUP BY 1),
nl AS (SELECT rid, w, list_transform(string_split(coalesce(text, ''), chr(10)), lambda y: len(regexp_extract_all("""
    + f"{_LOWER.format(x='y')}, {_W}"
    + """))) AS c FROM t),
sp AS (SELECT rid, w, c, unnest(range(1, len(c) + 1)) AS i FROM nl),
bl AS (SELECT rid, list_distinct(list_slice(w, coalesce(list_sum(c[1:i - 1]), 0)::BIGINT + 1, (coalesce(list_sum(c[1:i - 1]), 0) + c[i])::BIGINT + """
    + str(license_scan.reach(license_scan.TEMPLATES))
    + """)) AS s FROM sp),
m AS (SELECT rid, list_distinct(list(label)) AS labels, max(len(list_intersect(s, words)) / len(words)::DOUBLE) AS share FROM bl, tpl WHERE len(list_intersect(s, words)) >= 0.8 * len(words) - 1e-9 GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, f::BIGINT AS first_word, l::BIGINT AS last_word, coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') AS labels, CASE WHEN n > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM t LEFT JOIN b USING (rid) LEFT JOIN m USING (rid)"""
)

#: Anchors against all rows: the stated set of every hundredth row.
_OP11_SQL = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 5"""


@query("op4_quality_rules", _OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.clean(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars", "loss"
    )


@query("op5_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", bpe.encode_digest(F.col("text"), tokenizer_path()).alias("d")).select("doc_id", "d.*")


@query("op8_chat_format", _OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(
        "SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(t AS BIGINT) AS turn, r AS role, :said AS text FROM VALUES (0, 'user'), (1, 'assistant') AS v(t, r)",
        args={"said": said},
    )
    return chat.summary(chat.examples(turns.unionByName(extra)))


@query("op9_license_scan", _OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query("op10_simhash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query("op1_ann")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 50 = 0"), ann.build(vectors), k=5)


@query("op2_weak_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return weak_quality.classify(docs, weak_quality.fit(docs)).select("doc_id", "quality", "kept")


@query("op3_line_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("text_sha256"))


@query("op6_html_text")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"]).select("page_id", "url", "text", "n_chars")


@query("op7_mixing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs).select("doc_id", "source", "phase", "slot", "block", "place")


@query("op11_hard_negatives", _OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), hard_negatives.quantised(F.col("embedding"), 256).alias("embedding"))
    return hard_negatives.mine(rows, rows.where("vec_id % 100 = 0"))


@query("op12_importance")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_token_counts")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, tokenizer_path("word_bpe_49k.json")).drop("text")


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
