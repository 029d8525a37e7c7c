"""Which needles of any length stand in which texts, by an equi-join instead of every text against every needle; where each needle stands (``found``), by scans with an automaton as long as the needles are few.

Words are what white space parts. A needle of three words or more holds whole words of the text inside; the rarest of them, by document counts, is its key. A needle of one word lies inside a word of the
text, and of a needle of two words the first ends and the second begins one: these meet the texts' distinct words, of which there are far fewer than places, in an inverted index of q-grams
with their positions: (first, last or any q characters of a word) for the lengths q up to ``PART`` that the needles have. What meets is verified on the text itself, so the result is exact.

The texts' forms and words are written once and read from there, and so are the needles' keys: Spark sees their size and broadcasts them only below its own threshold; beyond, the join
shuffles, and AQE may split a frequent key. Needles whose every word is frequent meet as many texts as hold that word: their answer is of that size.

Defined results: an empty or blank needle, and a null one, stands nowhere; null texts hold nothing; needles that repeat are answered once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fusemill.checkpoint import shared_folder

#: Characters of a key that is no whole word.
PART = 8
#: Characters of needles in one automaton (a few hundred bytes each in a worker), and how many scans of the texts are better than the join.
SCAN_CHARS, SCANS = 500_000, 16


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as files in the shared folder, read again: computed once, and of a size that the planner knows."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def indexed(hay: DataFrame) -> DataFrame:
    """hay (id, unique, and hay) with its distinct words, written once."""
    return _written(hay.select("id", "hay").withColumn("words", F.array_distinct(_words(F.col("hay")))), "hay")


def _asked(needles: DataFrame) -> DataFrame:
    """needle, w (its words) and, for one or two words, kind and key: i for inside a word, s for its end, p for its start."""
    asked = needles.select("needle").where("needle IS NOT NULL").distinct().withColumn("w", _words(F.col("needle"))).where(F.size("w") > 0)
    a, b = F.get("w", F.lit(0)), F.get("w", F.lit(1))
    kind = F.when(F.size("w") == 1, "i").when((F.size("w") == 2) & (F.length(b) >= F.length(a)), "p").when(F.size("w") == 2, "s")
    # a word has a q-gram of each length at each place, so these come in few lengths: powers of two
    inside = F.least(F.lit(PART), F.floor(F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.length(a), F.lit(1)).cast("double"))))).cast("int"))
    key = F.when(kind == "s", F.right(a, F.lit(PART))).when(kind == "p", F.left(b, F.lit(PART))).when(kind == "i", F.left(a, inside))
    return _written(asked.select("needle", "w", kind.alias("kind"), key.alias("key")), "needles")


def _grams(word: Column, lengths: dict[str, list[int]]) -> Column:
    """The q-grams of a word for the lengths that are asked for: array of (kind, key, at), at the position from 1."""
    n = F.length(word)
    gram = lambda kind, at, q: F.struct(F.lit(kind).alias("kind"), F.substr(word, at, F.lit(q)).alias("key"), at.cast("int").alias("at"))
    none = F.array().cast("array<struct<kind:string,key:string,at:int>>")
    parts = [F.when(n >= q, F.array(gram("p", F.lit(1), q))) for q in lengths.get("p", [])]
    parts += [F.when(n >= q, F.array(gram("s", n - (q - 1), q))) for q in lengths.get("s", [])]
    inside = lambda q: lambda at: gram("i", at, q)
    parts += [F.when(n >= q, F.transform(F.sequence(F.lit(1), n - (q - 1)), inside(q))) for q in lengths.get("i", [])]
    return F.concat(*[F.coalesce(p, none) for p in parts])


def _brief(words: DataFrame, asked: DataFrame) -> DataFrame | None:
    """Distinct (needle, word): words of the texts that a needle of one or two words may lie at; None without such needles."""
    brief = asked.where("kind IS NOT NULL")
    lengths: dict[str, list[int]] = {}
    for r in brief.select("kind", F.length("key").alias("q")).distinct().collect():  # at most three kinds of PART lengths
        lengths.setdefault(r["kind"], []).append(r["q"])
    if not lengths:
        return None
    grams = words.select("word", F.explode(_grams(F.col("word"), lengths)).alias("g")).select("word", "g.*")
    met = grams.join(brief, ["kind", "key"])
    # a needle's part has to fit the word where its gram stands
    a, b = F.get("w", F.lit(0)), F.get("w", F.lit(1))
    fits = F.when(F.col("kind") == "i", F.substr("word", F.col("at"), F.length(a)) == a).when(F.col("kind") == "s", F.endswith("word", a)).otherwise(F.startswith("word", b))
    return met.where(fits).select("needle", "word").distinct()


def _candidates(index: DataFrame, asked: DataFrame, with_single: bool) -> DataFrame:
    """Distinct (id, needle) to verify; ``with_single``: needles of one word, too."""
    each = index.select("id", F.explode("words").alias("word"))
    inner = asked.where("kind IS NULL").select("needle", F.explode(F.array_distinct(F.slice("w", F.lit(2), F.size("w") - 2))).alias("word"))
    counts = each.join(inner.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # a word of no text is the rarest of all: such a needle meets nothing
    keys = inner.join(counts, "word", "left").groupBy("needle").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"))
    brief = _brief(each.select("word").distinct(), asked if with_single else asked.where("kind IS NULL OR kind <> 'i'"))
    if brief is not None:
        keys = keys.unionByName(brief)
    return each.join(_written(keys, "keys"), "word").select("id", "needle").distinct()


def _scanned(hay: DataFrame, needles: list[str]) -> DataFrame:
    """(id, needle) by one scan of the texts where they lie: each task builds the automaton of the needles, which are broadcast."""
    shared = hay.sparkSession.sparkContext.broadcast(needles)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = ahocorasick.Automaton()
        for n in shared.value:
            trie.add_word(n, n)
        trie.make_automaton()
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.iloc[k : k + 256]
                rows = [(i, n) for i, t in zip(part["id"], part["hay"], strict=True) if t for n in {n for _, n in trie.iter(t)}]
                yield pd.DataFrame(rows, columns=["id", "needle"])

    return hay.select("id", "hay").mapInPandas(run, f"id {hay.schema['id'].dataType.simpleString()}, needle string")


def found(hay: DataFrame, needles: DataFrame, scan_chars: int = SCAN_CHARS, scans: int = SCANS) -> DataFrame:
    """Distinct (id, needle) where the needle stands in the text. hay: id (unique), hay; needles: needle.

    Needles of up to ``scan_chars`` characters together take one scan of the texts, without a shuffle; up to ``scans`` times as many are dealt to so many scans. Beyond, texts meet needles
    by the equi-join, whose disk goes with the texts' words.
    """
    plain = _written(needles.select("needle").where(F.col("needle").rlike(r"\S")).distinct(), "asked")
    chars = plain.agg(F.coalesce(F.sum(F.length("needle")), F.lit(0))).first()[0]
    parts = max(1, -(-chars // scan_chars))
    if parts <= scans:
        dealt: list[list[str]] = [[] for _ in range(parts)]
        for r in plain.withColumn("part", F.pmod(F.xxhash64("needle"), F.lit(parts))).toLocalIterator():  # scans * scan_chars characters at most
            dealt[r["part"]].append(r["needle"])
        each = [_scanned(hay, part) for part in dealt if part]
        return reduce(DataFrame.union, each) if each else hay.select("id", F.lit("").alias("needle")).where(F.lit(False))
    index, asked = indexed(hay), _asked(plain)
    met = _candidates(index, asked, True)
    return met.join(index.select("id", "hay"), "id").where(F.contains(F.col("hay"), F.col("needle"))).select("id", "needle")


def standing(hay: DataFrame, needles: DataFrame) -> DataFrame:
    """Distinct needles that stand in any text. A needle of one word (without white space at its ends) is settled by the texts' words alone."""
    index, asked = indexed(hay), _asked(needles)
    bare = asked.where(F.get("w", F.lit(0)) == F.col("needle"))
    vocabulary = index.select(F.explode("words").alias("word")).distinct()
    single = _brief(vocabulary, bare)
    wide = asked.join(bare.select("needle"), "needle", "left_anti")
    met = _candidates(index, wide, True)
    out = met.join(index.select("id", "hay"), "id").where(F.contains(F.col("hay"), F.col("needle"))).select("needle").distinct()
    return out if single is None else out.unionByName(single.select("needle").distinct())


def any_all(items: DataFrame, hay: DataFrame) -> DataFrame:
    """id, src, keep. items: id, src, needles (array); a source nq is kept if any needle stands in a text, others if all do and there is one."""
    each = items.select("id", "src", F.explode_outer(F.array_distinct("needles")).alias("needle"))
    hit = standing(hay, each.select("needle")).withColumn("hit", F.lit(True))
    marked = each.join(hit, "needle", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    keep = F.when(F.max("src") == "nq", F.bool_or("hit")).otherwise(F.bool_and("hit"))
    return marked.groupBy("id").agg(F.max("src").alias("src"), keep.alias("keep"))


def covered(samples: DataFrame, texts: DataFrame) -> DataFrame:
    """id and covered: whether any of a sample's answers, trimmed and in lower case, stands in a text in lower case. samples: id, answers (array); texts: id, text."""
    trimmed = lambda a: F.regexp_replace(F.lower(a), r"^\s+|\s+$", "")
    each = samples.select("id", F.explode_outer(F.array_distinct(F.transform("answers", trimmed))).alias("needle"))
    hit = standing(texts.select("id", F.lower("text").alias("hay")), each.select("needle")).withColumn("hit", F.lit(True))
    return each.join(hit, "needle", "left").groupBy("id").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("covered"))
