"""Gold support sentences set against the corpus' own sentences of the same title.

Sentences meet by title; a title's sentences are as many as its article has. Vectors come as a table, so that no model runs here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fusemill.functions.text import contains_normalized, matching_form, rouge_l, sentences
from fusemill.operators.ranking import cosine


def title_sentences(chunks: DataFrame) -> DataFrame:
    """title, pos, sentence: each title's sentences, the first of each matching form. chunks: title, pos (order of a title's chunks), text."""
    fit = chunks.where((F.trim(F.coalesce("title", F.lit(""))) != "") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    each = fit.select(F.trim("title").alias("title"), "pos", F.posexplode(sentences(F.col("text"))).alias("k", "sentence"))
    each = each.withColumn("form", matching_form(F.col("sentence"))).where("form <> ''")
    return each.groupBy("title", "form").agg(F.min_by(F.struct("pos", "k", "sentence"), F.struct("pos", "k")).alias("s")).select("title", F.struct("s.pos", "s.k").alias("pos"), "s.sentence")


def present(gold: Column, candidate: Column) -> Column:
    """Whether a candidate is or holds the gold; an empty gold always counts as there."""
    form = matching_form(gold)
    return (form == "") | (matching_form(candidate) == form) | contains_normalized(candidate, gold)


def align(anchors: DataFrame, candidates: DataFrame, vectors: DataFrame, tau_sem: float = 0.92, tau_lex: float = 0.75) -> DataFrame:
    """One decision an anchor: replacement (null if none), reason, semantic_cosine, rouge_l, and the nearest candidate.

    anchors: anchor_id, title, sentence; candidates: title, sentence; vectors: sentence, vec. A candidate replaces the gold if both measures reach their
    thresholds; of several, the greatest cosine, then ROUGE-L, then the first by text. Reasons: no_corpus_chunks_for_title, already_present,
    below_thresholds, aligned.
    """
    v = vectors.groupBy("sentence").agg(F.first("vec").alias("vec"))
    asked = anchors.select("anchor_id", F.trim("title").alias("title"), F.col("sentence").alias("gold")).join(v.select(F.col("sentence").alias("gold"), F.col("vec").alias("gold_vec")), "gold", "left")
    offered = candidates.select(F.trim("title").alias("title"), F.col("sentence").alias("candidate")).distinct().join(v.select(F.col("sentence").alias("candidate"), "vec"), "candidate", "left")
    met = asked.join(offered, "title").select("anchor_id", "gold", "candidate", present(F.col("gold"), F.col("candidate")).alias("there"), F.coalesce(cosine(F.col("gold_vec"), F.col("vec")), F.lit(0.0)).alias("sem"), rouge_l(F.col("gold"), F.col("candidate")).alias("lex"))
    order = F.struct((-F.col("sem")).alias("s"), (-F.col("lex")).alias("l"), F.col("candidate").alias("c"))
    pick = F.struct("candidate", "sem", "lex")
    fit = (F.col("sem") >= tau_sem) & (F.col("lex") >= tau_lex)
    best = met.groupBy("anchor_id").agg(F.bool_or("there").alias("there"), F.min_by(pick, order).alias("nearest"), F.min_by(F.when(fit, pick), F.when(fit, order)).alias("taken"))
    out = anchors.join(best, "anchor_id", "left")
    reason = F.when(F.col("nearest").isNull(), "no_corpus_chunks_for_title").when(F.col("there"), "already_present").when(F.col("taken").isNull(), "below_thresholds").otherwise("aligned")
    out = out.withColumn("reason", reason)
    shown = F.when(F.col("reason") == "aligned", F.col("taken")).when(F.col("reason") == "below_thresholds", F.col("nearest"))
    measure = lambda field: F.when(F.col("reason") == "already_present", 1.0).otherwise(F.coalesce(shown[field], F.lit(0.0)))
    return out.select("anchor_id", "title", "sentence", "reason", F.when(F.col("reason") == "aligned", F.col("taken.candidate")).alias("replacement"), measure("sem").alias("semantic_cosine"), measure("lex").alias("rouge_l"), shown["candidate"].alias("nearest_candidate"))


def rewritten(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """question_id, gold_support_sentences with replacements put in, and resolved: whether each line was replaced or there already.

    items: question_id, pos, sentence; decisions: question_id, pos, replacement, reason.
    """
    met = items.join(decisions.select("question_id", "pos", "replacement", "reason"), ["question_id", "pos"], "left")
    line = F.struct("pos", F.coalesce("replacement", "sentence").alias("s"))
    fine = F.coalesce(F.col("reason").isin("aligned", "already_present"), F.lit(False))
    g = met.groupBy("question_id").agg(F.sort_array(F.collect_list(line)).alias("x"), F.bool_and(fine).alias("resolved"))
    return g.select("question_id", F.transform("x", lambda y: y["s"]).alias("gold_support_sentences"), "resolved")
