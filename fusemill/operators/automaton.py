"""Dictionaries built once as Aho-Corasick automata, kept as a table with their fingerprint, and used for many texts.

The artifact is a Parquet table of parts: phrases are dealt to parts by a hash of the whole phrase, and each part is one automaton in bytes. Any
session that reads the shared folder can load it. While an artifact's bytes stay below a limit, they are broadcast, and texts are scanned where they
lie, without a shuffle; a larger dictionary meets the texts in the equi-join of ``phrases.matches``. Both give the same rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fusemill.functions.text import entity_key
from fusemill.operators import entities, phrases

PART_CHARS = 4_000_000
BROADCAST_BYTES = 64_000_000
_FOUND = "id {}, start int, end int, match_key string, canonical string, df int, prio int"


def _built(rows: pd.DataFrame) -> pd.DataFrame:
    trie = ahocorasick.Automaton()
    for key, canonical, df, prio in zip(rows["match_key"], rows["canonical"], rows["df"], rows["prio"], strict=True):
        trie.add_word(key, (key, canonical, int(df), int(prio)))
    trie.make_automaton()
    return pd.DataFrame([(int(rows["part"].iloc[0]), pickle.dumps(trie))], columns=["part", "trie"])


def stored(dictionary: DataFrame, folder: str, part_chars: int = PART_CHARS) -> str:
    """The path of the dictionary's artifact under ``folder``; built only if no whole one bears the dictionary's fingerprint.

    dictionary: match_key, canonical, df, prio. Of records with one match_key the best counts (``phrases.best_records``). Null and empty
    phrases and those that begin with white space match nothing and are left out.
    """
    spark = dictionary.sparkSession
    keys = phrases.best_records(dictionary.where(F.length("match_key") > 0).select("match_key", "canonical", "df", "prio"))
    keys = keys.where(~F.col("match_key").rlike(r"(?U)^\s")).withColumns({"df": F.coalesce("df", F.lit(0)), "prio": F.coalesce("prio", F.lit(0))})
    path = f"{folder.rstrip('/')}/{entities.fingerprint(keys)}"
    if _parts(spark, path) is None:
        chars = keys.agg(F.coalesce(F.sum(F.length("match_key")), F.lit(0))).first()[0]
        dealt = keys.withColumn("part", F.pmod(F.xxhash64("match_key"), F.lit(chars // part_chars + 1)).cast("int"))
        tries = dealt.groupBy("part").applyInPandas(_built, "part int, trie binary")
        tries.write.mode("overwrite").parquet(f"{path}/tries")
        keys.write.mode("overwrite").parquet(f"{path}/keys")
        done = spark.read.parquet(f"{path}/tries").agg(F.count(F.lit(1)).alias("parts"), F.coalesce(F.sum(F.length("trie")), F.lit(0)).alias("bytes"))
        done.write.mode("overwrite").parquet(f"{path}/done")  # last: without it the artifact isn't whole
    return path


def _parts(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """Parts and bytes of a whole artifact, None if there is none."""
    try:
        row = spark.read.schema("parts long, bytes long").parquet(f"{path}/done").first()
    except AnalysisException:
        return None
    return None if row is None else (row["parts"], row["bytes"])


def _scan(text: str, tries: list) -> list[tuple]:
    """Phrases from left to right without overlap: the longest from each place, neither of whose ends lies inside a run of letters and digits."""
    longest: dict[int, tuple] = {}
    for trie in tries:
        for last, record in trie.iter(text):
            start = last - len(record[0]) + 1
            if start not in longest or len(record[0]) > len(longest[start][0]):
                longest[start] = record
    out, free = [], 0
    for start in sorted(longest):
        end = start + len(longest[start][0])
        inside = (start and text[start - 1].isalnum() and text[start].isalnum()) or (end < len(text) and text[end - 1].isalnum() and text[end].isalnum())
        if start >= free and not inside:
            out.append((start, end, *longest[start]))
            free = end
    return out


def matches(texts: DataFrame, path: str, id_col: str, text_col: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """id, start, end (code points, end exclusive), match_key, canonical, df, prio, by the artifact at ``path``; null and empty texts match nothing."""
    spark = texts.sparkSession
    known = _parts(spark, path)
    if known is None:
        raise ValueError(f"no whole artifact: {path}")
    if known[1] > broadcast_bytes:
        return phrases.matches(texts, spark.read.parquet(f"{path}/keys"), id_col, text_col)
    shared = spark.sparkContext.broadcast([bytes(r["trie"]) for r in spark.read.parquet(f"{path}/tries").select("trie").collect()])  # below broadcast_bytes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tries = [pickle.loads(b) for b in shared.value]
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.iloc[k : k + 256]
                rows = [(i, *m) for i, t in zip(part["id"], part["text"], strict=True) if t for m in _scan(t, tries)]
                yield pd.DataFrame(rows, columns=["id", "start", "end", "match_key", "canonical", "df", "prio"])

    kind = texts.schema[id_col].dataType.simpleString()
    return texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, _FOUND.format(kind))


def title_dictionary(titles: DataFrame, alias: DataFrame | None = None) -> DataFrame:
    """match_key, canonical, df, prio of titles (column title) and of aliases (alias, canonical, both any form) of titles that are there.

    Titles of one entity key are one title, the smallest text; a phrase that is a title itself isn't an alias of another.
    """
    known = titles.select(F.trim("title").alias("title")).where("title <> ''").groupBy(entity_key(F.col("title")).alias("key")).agg(F.min("title").alias("title")).where("key <> ''")
    own = known.select(F.lower("title").alias("match_key"), F.col("title").alias("canonical"), F.lit(0).alias("df"), F.lit(0).alias("prio"))
    if alias is None:
        return own
    named = alias.select(F.lower(F.trim("alias")).alias("match_key"), entity_key(F.col("canonical")).alias("key")).where("match_key <> ''")
    return own.unionByName(named.join(known, "key").select("match_key", F.col("title").alias("canonical"), F.lit(1).alias("df"), F.lit(1).alias("prio")))


def titles_in_order(texts: DataFrame, path: str, id_col: str = "id", text_col: str = "text", most: int | None = 50) -> DataFrame:
    """id, rank (from 1), title: distinct titles of each text by their first occurrence, at most ``most`` of a text (None: all)."""
    lowered = texts.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text"))
    first = matches(lowered, path, "id", "text").groupBy("id", F.col("canonical").alias("title")).agg(F.min("start").alias("start"))
    listed = first.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "title"))).alias("t"))  # one text's titles
    cut = F.col("t") if most is None else F.slice("t", 1, most)
    return listed.select("id", F.posexplode(cut).alias("pos", "t")).select("id", (F.col("pos") + 1).alias("rank"), "t.title")
