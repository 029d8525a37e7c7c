"""Dictionary phrases in texts: longest match from each place, then left to right without overlap.

A match may not begin or end inside a run of letters and digits. If the longest phrase from a place ends inside such a run, no shorter one is
tried there. A phrase therefore begins with the whole run that stands at its place, so texts meet the dictionary in an equi-join on that
first run (or first character, where that is neither letter nor digit), and AQE may split a frequent run. Places whose first run begins no phrase are left out before
the join by a table of ``SLOTS`` hashed bits, a megabyte whatever the dictionary; the join decides. Places leave a task by the ``PLACES``, not by the batch of texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PLACE = re.compile(r"[^\W_]+|\S")
#: Bits of the table of first runs, and places of a text that are handed on at a time.
SLOTS, PLACES = 1 << 23, 1 << 14


def _slot(stem: str) -> int:
    return zlib.crc32(stem.encode("utf-8", "surrogatepass")) % SLOTS


def _slot_bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    bits = np.zeros(SLOTS, dtype=bool)
    for b in batches:
        bits[[_slot(s) for s in b["stem"]]] = True
    yield pd.DataFrame({"bits": [np.packbits(bits).tobytes()]})


def places(texts: DataFrame, keys: DataFrame, longest: int) -> DataFrame:
    """id, start, stem, ahead: places where a phrase may begin, each with its first run and the next ``longest`` + 1 characters. texts: id, text; keys: stem."""
    parts = keys.select("stem").mapInPandas(_slot_bits, "bits binary").rdd.map(lambda r: np.frombuffer(r[0], dtype=np.uint8))
    known = texts.sparkSession.sparkContext.broadcast(parts.treeAggregate(np.zeros(SLOTS // 8, dtype=np.uint8), np.bitwise_or, np.bitwise_or).tobytes())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, out = known.value, []
        named = lambda: pd.DataFrame(out, columns=["id", "start", "stem", "ahead"])
        for batch in batches:
            for i, t in zip(batch["id"], batch["text"].fillna(""), strict=True):
                for m in _PLACE.finditer(t):
                    slot = _slot(m[0])
                    if bits[slot >> 3] & (128 >> (slot & 7)):
                        out.append((i, m.start(), m[0], t[m.start() : m.start() + longest + 1]))
                        if len(out) >= PLACES:
                            yield named()
                            out = []
        if out:
            yield named()

    return texts.mapInPandas(run, f"id {texts.schema['id'].dataType.simpleString()}, start int, stem string, ahead string")


def stems(keys: Column) -> Column:
    """The first run of each phrase."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([m[0] if (m := _PLACE.match(k)) else None for k in values.fillna("")], dtype=object)

    return run(keys)


def best_records(records: DataFrame) -> DataFrame:
    """One record of each match_key: lowest df, then lowest prio (of the source), then canonical."""
    return records.groupBy("match_key").agg(F.min_by(F.struct("canonical", "df", "prio"), F.struct("df", "prio", "canonical")).alias("r")).select("match_key", "r.*")


def matches(texts: DataFrame, dictionary: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, start, end (code points, end exclusive), match_key, canonical, df, prio.

    Ids are unique. Null and empty texts match nothing; an empty dictionary gives an empty result. A document's own matches are folded in one
    array, which is no longer than the document.
    """
    keys = best_records(dictionary.where(F.length("match_key") > 0)).withColumn("stem", stems(F.col("match_key"))).where(F.col("stem").isNotNull())
    longest = keys.agg(F.max(F.length("match_key"))).first()[0] or 0
    at = places(texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), keys, longest)
    n = F.length("match_key")
    found = at.join(keys, "stem").where(F.startswith("ahead", "match_key"))
    longest_here = found.groupBy("id", "start").agg(F.max_by(F.struct("match_key", "canonical", "df", "prio", "ahead"), n).alias("m"))
    size = F.length("m.match_key")
    whole = longest_here.where(~F.substr("m.ahead", size, F.lit(2)).rlike(r"^[\p{L}\p{N}]{2}"))
    one = F.struct("start", (F.col("start") + size).alias("end"), F.col("m.match_key").alias("match_key"), F.col("m.canonical").alias("canonical"), F.col("m.df").alias("df"), F.col("m.prio").alias("prio"))
    # a match stands unless an accepted one before it reaches into it: the fold carries the last end, flags come out in order
    listed = whole.select("id", one.alias("m")).groupBy("id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    empty = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("starts"))
    kept = F.aggregate("ms", empty, lambda s, m: F.when(m["start"] >= s["end"], F.struct(m["end"].alias("end"), F.array_append(s["starts"], m["start"]).alias("starts"))).otherwise(s))
    return listed.select("id", "ms", kept["starts"].alias("k")).select("id", F.explode(F.filter("ms", lambda m: F.array_contains("k", m["start"]))).alias("m")).select("id", "m.*")


def rank_and_cap(found: DataFrame, most: int = 12, max_df: int | None = 8) -> DataFrame:
    """id, rank (from 1), canonical: longest span, lowest df, prio, start, name; each name once; phrases of a greater df go."""
    fit = found if max_df is None else found.where(F.col("df") <= max_df)
    order = [(F.col("end") - F.col("start")).desc(), "df", "prio", "start", "canonical"]
    first = fit.withColumn("k", F.row_number().over(Window.partitionBy("id", "canonical").orderBy(*order))).where("k = 1")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where(F.col("rank") <= most).select("id", "rank", "canonical")
