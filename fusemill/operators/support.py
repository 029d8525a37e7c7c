"""Support sentences: visible tokens with their offsets, keywords, and the sentence that fits an answer best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fusemill.functions.text import collapse

#: Words that are no keywords (fixed values).
STOP_WORDS = "a an and are as at be by for from in is it of on or that the to was were with".split()


def keyword_terms(text: Column) -> Column:
    """Distinct words in lower case, longer than one character, without stop words; null text has none."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.array_except(F.filter(words, lambda t: F.length(t) > 1), F.array(*[F.lit(w) for w in STOP_WORDS]))


def answer_match_form(text: Column) -> Column:
    """Lower case, bar and punctuation as spaces, no space before closing punctuation, white space collapsed."""
    out = F.regexp_replace(F.replace(F.lower(text), F.lit("|"), F.lit(" ")), r"\s+([,.;:!?%])", "$1")
    return collapse(F.regexp_replace(out, r"[^\p{L}\p{N}_\s]", " "))


def visible_tokens(docs: DataFrame, id_col: str, tokens: str = "tokens", is_html: str = "is_html") -> DataFrame:
    """id, i (place among all tokens), at (place among the visible ones), token, start, end: offsets in the visible text joined by single spaces.

    Ids are unique; tokens beyond the shorter of the two arrays, markup and blank tokens aren't visible.
    """
    n = F.least(F.size(tokens), F.size(is_html))
    each = docs.select(F.col(id_col).alias("id"), F.posexplode(F.arrays_zip(F.col(tokens).alias("t"), F.col(is_html).alias("h"))).alias("i", "x"), n.alias("n"))
    shown = each.where((F.col("i") < F.col("n")) & ~F.coalesce(F.col("x.h"), F.lit(False))).select("id", "i", F.trim(F.coalesce(F.col("x.t"), F.lit(""))).alias("token")).where("token <> ''")
    w = Window.partitionBy("id").orderBy("i")
    end = F.sum(F.length("token") + 1).over(w) - 1
    return shown.select("id", "i", (F.row_number().over(w) - 1).alias("at"), "token", (end - F.length("token")).alias("start"), end.alias("end"))


def span_offsets(visible: DataFrame, spans: DataFrame) -> DataFrame:
    """id, first, last, start, end: the visible part of each token span (id, first_token, last_token, the last included); spans without any go."""
    met = visible.join(spans, "id").where(F.col("i").between(F.col("first_token"), F.col("last_token")))
    return met.groupBy("id", "first_token", "last_token").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.min("start").alias("start"), F.max("end").alias("end")).drop("first_token", "last_token")


def best_sentence(candidates: Column, answers: Column, context: Column, question: Column) -> Column:
    """The candidate holding an answer that shares most terms with the context, then with the question, then the shortest, then the first; null if none."""
    wanted = F.filter(F.transform(F.filter(answers, lambda a: F.trim(a) != ""), answer_match_form), lambda a: a != "")

    def rank(s: Column, k: Column) -> Column:
        terms = keyword_terms(s)
        holds = F.exists(wanted, lambda a: F.contains(answer_match_form(s), a))
        order = F.struct(F.size(F.array_intersect(terms, context)).alias("c"), F.size(F.array_intersect(terms, question)).alias("q"), (-F.length(s)).alias("n"), (-k).alias("k"))
        return F.when(holds, order)

    return F.get(candidates, -F.array_max(F.transform(candidates, rank))["k"])
