"""Text, answer and corpus-filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fusemill.functions import batch, text
from fusemill.operators import containment
from fusemill.registry import register
from fusemill.sources.tables import table

_MATCH = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower({x}), 'ß', 'ss'), '\|', ' ', 'g'), '\s+([,.;:!?%])', '\1', 'g'), '([(\[{{])\s+', '\1', 'g'), '\s+([)\]}}])', '\1', 'g'), '\s+', ' ', 'g'))"
_LETTER = r"\p{{L}}\p{{N}}_"
_ARTICLE = rf"'(^|[^{_LETTER}])(a|an|the)($|[^{_LETTER}])', '\1 \3', 'g'"  # twice: articles next to each other share a separator
_ANSWER = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({x}), " + _ARTICLE + "), " + _ARTICLE + r"), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+', ' ', 'g'))"


@register("norm_matching", f"SELECT item_id, {_MATCH.format(x='text')} AS norm FROM benchmark")
def norm_matching(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", text.matching_form(F.col("text")).alias("norm"))


@register("norm_answer", f"SELECT item_id, {_ANSWER.format(x='text')} AS norm FROM benchmark")
def norm_answer(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", text.answer_form(F.col("text")).alias("norm"))


@register("question_hash", r"SELECT item_id, sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS question_id, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS text_hash FROM benchmark")
def question_hash(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "benchmark").select("item_id", text.question_id(t).alias("question_id"), text.question_text_hash(t).alias("text_hash"))


_QA = f"""WITH t AS (SELECT conv_id, turn, role, text FROM conversations),
p AS (SELECT a.conv_id, a.turn, {_ANSWER.format(x='a.text')} AS p, {_ANSWER.format(x='b.text')} AS g FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 WHERE a.role = 'assistant'),
k AS (SELECT *, list_filter(string_split(p, ' '), lambda x: x <> '') AS pt, list_filter(string_split(g, ' '), lambda x: x <> '') AS gt FROM p)
"""


def _qa(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    a = t.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("p"))
    b = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("g"))
    return a.join(b, ["conv_id", "turn"])


@register("exact_match", _QA + "SELECT conv_id, turn, (p <> '' AND p = g)::INT::DOUBLE AS em FROM k")
def exact_match(spark, sf_dir):
    p, g = text.answer_form(F.col("p")), text.answer_form(F.col("g"))
    return _qa(spark, sf_dir).select("conv_id", "turn", ((p != "") & (p == g)).cast("int").cast("double").alias("em"))


@register(
    "token_f1",
    _QA
    + "SELECT conv_id, turn, round(CASE WHEN len(pt) = 0 AND len(gt) = 0 THEN 1.0 ELSE 2.0 * list_sum(list_transform(list_distinct(pt), lambda x: least(len(list_filter(pt, lambda y: y = x)), len(list_filter(gt, lambda y: y = x))))) / (len(pt) + len(gt)) END, 6) AS f1 FROM k",
)
def token_f1(spark, sf_dir):
    t = _qa(spark, sf_dir).select("conv_id", "turn", text.answer_tokens(F.col("p")).alias("p"), text.answer_tokens(F.col("g")).alias("g"))
    return t.select("conv_id", "turn", F.round(text.f1_tokens(F.col("p"), F.col("g")), 6).alias("f1"))


@register("sentences", r"SELECT item_id, count(*) AS n, max(length(s)) AS longest FROM (SELECT item_id, trim(unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))) AS s FROM benchmark) WHERE s <> '' GROUP BY 1")
def sentences(spark, sf_dir):
    s = table(spark, sf_dir, "benchmark").select("item_id", F.explode(text.sentences(F.col("text"))).alias("s"))
    return s.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("s")).cast("long").alias("longest"))


_SUPPORT = rf"""WITH d AS (SELECT doc_id, {_MATCH.format(x='text')} AS hay FROM documents),
s0 AS (SELECT item_id, trim(unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))) AS s FROM benchmark),
s AS (SELECT DISTINCT item_id, {_MATCH.format(x='s')} AS needle FROM s0 WHERE s <> ''),
f AS (SELECT item_id, needle, EXISTS (SELECT 1 FROM d WHERE contains(d.hay, s.needle)) AS found FROM s),
k AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'nq' ELSE '2wiki' END AS src, CASE WHEN item_id % 2 = 0 THEN bool_or(found) ELSE bool_and(found) END AS keep FROM f GROUP BY 1)
"""


def _support(spark, sf_dir):
    """item_id, src, keep. Sentences meet documents by their rarest word."""
    needles = F.transform(text.sentences(F.col("text")), text.matching_form)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.when(F.col("item_id") % 2 == 0, "nq").otherwise("2wiki").alias("src"), needles.alias("needles"))
    hay = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.matching_form(F.col("text")).alias("hay"))
    return containment.any_all(items, hay).withColumnRenamed("id", "item_id")


@register("support_filter_any_all", _SUPPORT + "SELECT item_id, src FROM k WHERE keep")
def support_filter(spark, sf_dir):
    return _support(spark, sf_dir).where("keep").select("item_id", "src")


@register("drop_counts", _SUPPORT + "SELECT src, count(*) FILTER (NOT keep) AS dropped, count(*) AS n FROM k GROUP BY 1")
def drop_counts(spark, sf_dir):
    return _support(spark, sf_dir).groupBy("src").agg(F.count_if(~F.col("keep")).alias("dropped"), F.count(F.lit(1)).alias("n"))


# an item's answers: its first word, its last two words, and its first six characters
_COVER = r"""WITH w AS (SELECT item_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM benchmark),
a AS (SELECT item_id, lower(trim(unnest([w[1], w[-2] || ' ' || w[-1], left(text, 6)]))) AS needle FROM w),
c AS (SELECT item_id, coalesce(bool_or(needle <> '' AND EXISTS (SELECT 1 FROM documents WHERE contains(lower(text), needle))), false) AS covered FROM a GROUP BY 1)
"""


def _covered(spark, sf_dir):
    w = F.array_remove(F.split("text", r"\s+"), "")
    answers = F.array(F.get(w, F.lit(0)), F.concat(F.try_element_at(w, F.lit(-2)), F.lit(" "), F.try_element_at(w, F.lit(-1))), F.left("text", F.lit(6)))
    samples = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), answers.alias("answers"))
    return containment.covered(samples, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


@register("answer_coverage", _COVER + "SELECT item_id, covered FROM c")
def answer_coverage(spark, sf_dir):
    return _covered(spark, sf_dir).withColumnRenamed("id", "item_id")


@register("coverage_gate", _COVER + "SELECT count(*) AS samples, round(avg(covered::INT), 6) AS coverage_rate, avg(covered::INT) >= 0.2 AS passes FROM c")
def coverage_gate(spark, sf_dir):
    rate = F.avg(F.col("covered").cast("int"))
    return _covered(spark, sf_dir).agg(F.count(F.lit(1)).alias("samples"), F.round(rate, 6).alias("coverage_rate"), (rate >= 0.2).alias("passes"))


# every two-word start and single word of the benchmark, against every document
_PLACES = r"""WITH w AS (SELECT list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM benchmark),
n AS (SELECT DISTINCT unnest([right(w[1], 3), right(w[1], 3) || ' ' || left(w[2], 2), w[2] || ' ' || left(w[3], 1), w[1] || ' ' || w[2] || ' ' || w[3]]) AS needle FROM w)
"""


@register("needle_places", _PLACES + "SELECT doc_id, needle FROM documents JOIN n ON needle <> '' AND contains(text, needle)")
def needle_places(spark, sf_dir):
    """Where short pieces of the benchmark stand in the documents: parts of a word, of two words, and three words."""
    w = F.array_remove(F.split("text", r"\s+"), "")
    at = lambda k: F.get(w, F.lit(k))
    space = F.lit(" ")
    pieces = F.array(F.right(at(0), F.lit(3)), F.concat(F.right(at(0), F.lit(3)), space, F.left(at(1), F.lit(2))), F.concat(at(1), space, F.left(at(2), F.lit(1))), F.concat(at(0), space, at(1), space, at(2)))
    needles = table(spark, sf_dir, "benchmark").select(F.explode(pieces).alias("needle"))
    return containment.found(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("hay")), needles).withColumnRenamed("id", "doc_id")


@register("chunk_windows", r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS toks FROM documents),
p AS (SELECT doc_id, toks, unnest(range(0, greatest(len(toks), 1), 400)) AS p0 FROM w)
SELECT doc_id, floor(p0 / 400)::INT AS chunk, len(list_slice(toks, p0 + 1, p0 + 500)) AS n_tokens, sha256(array_to_string(list_slice(toks, p0 + 1, p0 + 500), ' ')) AS chunk_hash FROM p""")
def chunk_windows(spark, sf_dir):
    """Windows of 500 tokens, 100 shared with the one before."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.array_remove(F.split("text", r"[ \t\n\r\f\x0B]+"), "").alias("toks"))
    p = w.select("doc_id", "toks", F.explode(F.sequence(F.lit(0), F.greatest(F.size("toks") - 1, F.lit(0)), F.lit(400))).alias("at"))
    part = F.slice("toks", F.col("at") + 1, F.lit(500))
    return p.select("doc_id", F.floor(F.col("at") / 400).cast("int").alias("chunk"), F.size(part).cast("long").alias("n_tokens"), F.sha2(F.array_join(part, " "), 256).alias("chunk_hash"))


@register("custom_id_roundtrip", "SELECT event_id, 'run::' || replace(event_type, '::', '__') || '::' || event_id AS custom_id, event_type AS back FROM events")
def custom_id_roundtrip(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", batch.custom_id(F.lit("run"), F.col("event_type"), F.col("event_id")).alias("custom_id"))
    return e.withColumn("back", F.get(batch.custom_id_parts(F.col("custom_id")), F.lit(1)))
