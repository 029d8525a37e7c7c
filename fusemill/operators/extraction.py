"""Clean-up of extracted triples and the entities they name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusemill.functions.records import evidence_span
from fusemill.functions.text import entity_key

#: Predicates that say nothing (fixed values).
EMPTY_PREDICATES = ["is", "was", "has", "had", "mentions", "discusses", "related_to"]


def clean_triples(raw: DataFrame) -> DataFrame:
    """One row of each (chunk_id, subj_norm, pred, obj_norm), the first by pos.

    raw: chunk_id, pos, subj_surface, pred, obj_surface, confidence, evidence, text. Rows without subject, predicate or object, or with an empty
    predicate, go; confidence is 0.8 if null and lies in 0 to 1. A partial aggregate, no window.
    """
    tidy = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    df = raw.withColumns({c: tidy(c) for c in ("subj_surface", "pred", "obj_surface", "evidence")})
    df = df.where((F.col("subj_surface") != "") & (F.col("pred") != "") & (F.col("obj_surface") != "") & ~F.lower("pred").isin(EMPTY_PREDICATES))
    df = df.withColumns({"subj_norm": entity_key(F.col("subj_surface")), "obj_norm": entity_key(F.col("obj_surface"))}).where((F.col("subj_norm") != "") & (F.col("obj_norm") != ""))
    spelled = F.concat_ws(" ", "subj_surface", "pred", "obj_surface")
    df = df.withColumns(
        {
            "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("confidence").cast("double"), F.lit(0.8)))),
            "match_text": F.when(F.col("evidence") != "", F.col("evidence")).otherwise(spelled),
            "span": evidence_span(F.col("evidence"), F.coalesce(F.col("text"), F.lit(""))),
        }
    )
    kept = F.min_by(F.struct("pos", "subj_surface", "obj_surface", "confidence", "match_text", "span"), F.col("pos")).alias("r")
    one = df.groupBy("chunk_id", "subj_norm", "pred", "obj_norm").agg(kept)
    return one.select("chunk_id", "subj_norm", "pred", "obj_norm", "r.*").withColumns({"start_char": F.col("span.start"), "end_char": F.col("span.end")}).drop("span")


def endpoints(triples: DataFrame) -> DataFrame:
    """chunk_id, norm, surface: each endpoint of a chunk's clean triples with its first surface (by pos, subject before object)."""
    ends = F.array(F.struct(F.col("subj_norm").alias("norm"), F.col("subj_surface").alias("surface"), F.lit(0).alias("side")), F.struct(F.col("obj_norm").alias("norm"), F.col("obj_surface").alias("surface"), F.lit(1).alias("side")))
    each = triples.select("chunk_id", "pos", F.explode(ends).alias("e")).select("chunk_id", "pos", "e.*")
    return each.groupBy("chunk_id", "norm").agg(F.min_by("surface", F.struct("pos", "side")).alias("surface"))
