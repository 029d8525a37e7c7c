"""Importance resampling of documents towards a target distribution, in two Arrow passes.

First pass: every partition counts its hashed one- and two-word features with np.bincount into one vector of ``buckets`` numbers, and treeReduce adds the vectors up, so
that the driver gets one vector however many partitions there are. The same is done for the target's texts. The log ratio of the two smoothed distributions gives each
bucket's gain. Second pass: the gains, ``buckets`` numbers, are broadcast; each batch gathers them for its features and sums them up by document with np.bincount's
weights. The mean gain is a document's weight; seeded Gumbel noise makes a draw of the highest scores a draw without replacement in proportion to exp(weight).

Scale: features are never rows. Drawing needs no sort of the table: scores are whole numbers within a range that doesn't depend on the number of documents (the gains lie
within 1000 * ln of the features' number, the noise within -3,200 and 23,000), so the driver takes the number of documents at each score, at most some 200,000 pairs, and finds the
score at which the draw ends. Documents are numbered within their score, and the noise spreads even copies of one text over thousands of scores. ``drawn`` then keeps documents by
comparing their own score and id with the last drawn ones: whole texts never move.

Defined results: null text has no features; a document without features has weight 0; a null id takes part with an empty id in its noise, and comes last among equal
scores; rows of equal id and score are numbered by their number of features; an empty table gives an empty result, an empty target makes every gain that of the smoothing alone;
texts of any length are read whole, in windows of ``WINDOW`` bytes; further columns pass under any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fusemill.llm.common import boxed, named, stored, unboxed

BUCKETS = 10_000
#: Bytes of a text whose words are held at once.
WINDOW = 1 << 20
#: Features that are summed up at once.
_FLUSH = 1 << 20
#: Words in UTF-8: digits, lower-case letters and everything beyond ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BREAK = re.compile(rb"[^0-9a-z\x80-\xff]")


def windows(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, window by window; windows end where no word does go on."""
    a = 0
    while a < len(raw):
        end = a + WINDOW
        if end < len(raw):
            stop = _BREAK.search(raw, end)
            end = stop.start() if stop else len(raw)
        yield _WORD.findall(raw, a, end)
        a = end


def features(raw: bytes | None, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of all words and of all pairs of neighbouring words of a text: CRC-32 of their UTF-8 modulo ``buckets``."""
    last: list[int] = []  # the hash of the window before's last word
    for words in windows((raw or b"").lower()):
        if not words:
            continue
        one = [*last, *map(crc32, words)]
        # a CRC goes on from the one of what stands before
        two = map(crc32, words[1 - len(last) :], map(crc32, repeat(b" "), one[:-1]))
        out = np.fromiter((*one[len(last) :], *two), dtype=np.int64)
        last = one[-1:]
        yield out % buckets


def feature_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket's features occur in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for raw in batch.column(0):
                for part in features(raw.as_py(), buckets):
                    total += np.bincount(part, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    parts = texts.select(named(text_col).cast("binary").alias("raw")).mapInArrow(count, "counts binary").rdd
    if not parts.getNumPartitions():
        return np.zeros(buckets, dtype=np.int64)
    return parts.map(lambda r: np.frombuffer(r[0], dtype=np.int64)).treeReduce(lambda a, b: a + b)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the target's smoothed share of each bucket over the corpus's."""
    n, s, t = len(corpus), corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, text_col: str = "text") -> Column:
    """struct(n_features, weight) of each text of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    @F.pandas_udf("struct<n_features:bigint,weight:bigint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        gain = sent.value
        for raws in batches:
            n, sums = np.zeros(len(raws), dtype=np.int64), np.zeros(len(raws))
            held: list[np.ndarray] = []
            rows: list[int] = []
            size = 0
            for k, raw in enumerate(raws):
                for part in features(raw, len(gain)):
                    held.append(part)
                    rows.append(k)
                    size += len(part)
                    if size >= _FLUSH:
                        _add(n, sums, rows, held, gain)
                        size = 0
            if held:
                _add(n, sums, rows, held, gain)
            yield pd.DataFrame({"n_features": n, "weight": sums.astype(np.int64) // np.maximum(n, 1)})

    return run(named(text_col).cast("binary"))


def _add(n: np.ndarray, sums: np.ndarray, rows: list[int], held: list[np.ndarray], gain: np.ndarray) -> None:
    """Add the held features to their documents' numbers and sums of gains (whole numbers below 2 ** 53, so exact in doubles)."""
    sizes = [len(x) for x in held]
    at = np.repeat(rows, sizes)
    sums += np.bincount(at, weights=gain[np.concatenate(held)], minlength=len(sums))
    n += np.bincount(rows, weights=sizes, minlength=len(n)).astype(np.int64)
    rows.clear()
    held.clear()


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise) of an id: its uniform number is the first 32 bits of a SHA-256."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scored(docs: DataFrame, target: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Input columns and n_features, weight, score: weight, the mean gain, plus noise. A column of a made name is replaced."""
    gain = gains(feature_counts(docs, text_col), feature_counts(target, target_col))
    own = docs.select(boxed(docs), weighted(docs, gain, text_col).alias("made"), noise(named(id_col), seed).alias("noise"))
    return unboxed(own, docs.columns, n_features=F.col("made.n_features"), weight=F.col("made.weight"), score=F.col("made.weight") + F.col("noise"))


def _eligible(min_words: int) -> Column:
    """n words make 2 n - 1 features."""
    return F.col("n_features") >= max(0, 2 * min_words - 1)


def ranked(scores: DataFrame, min_words: int = 20, percent: int = 25, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``scores`` (id, n_features, score and more) and rank: 1, 2, ... of the highest scores of those with ``min_words`` words, null for what isn't drawn.

    ``scores`` is read three times: have it written.
    """
    spark = scores.sparkSession
    at = scores.where(_eligible(min_words)).groupBy("score").count().collect()
    at.sort(key=lambda r: -r["score"])
    left = sum(r["count"] for r in at) * percent // 100
    starts, before = [], 0
    for r in at:
        if before >= left:
            break
        starts.append((r["score"], before))
        before += r["count"]
    if not starts:
        return scores.withColumn("rank", F.lit(None).cast("long"))
    reached = _eligible(min_words) & (F.col("score") >= starts[-1][0])
    place = Window.partitionBy("score").orderBy(F.col(id_col).asc_nulls_last(), "n_features")
    first = spark.createDataFrame(starts, "score bigint, before bigint")
    top = scores.where(reached).withColumn("place", F.row_number().over(place)).join(F.broadcast(first), "score")
    rank = F.col("before") + F.col("place")
    top = top.select(*scores.columns, F.when(rank <= left, rank).alias("rank"))
    return top.unionByName(scores.where(~reached).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, seed: int = 7, min_words: int = 20, percent: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_features, weight, score and rank (null: not drawn) of every document."""
    found = scored(docs.select(named(id_col).alias("id"), named(text_col).alias("text")), target, seed, "id").drop("text")
    return ranked(stored(found), min_words, percent, "id").select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, seed: int = 7, min_words: int = 20, percent: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are drawn, whole, with n_features, weight and score: each compares itself with the last one drawn."""
    rows = scored(docs, target, seed, id_col, text_col)
    key = stored(rows.where(_eligible(min_words)).select(named(id_col).alias("id"), "n_features", "score"))
    last = ranked(key, min_words, percent, "id").where("rank IS NOT NULL").agg(F.max_by(F.struct("score", "id", "n_features"), "rank").alias("l")).first()["l"]
    if last is None:
        return rows.limit(0)
    i, score = named(id_col), F.col("score")
    if last["id"] is None:
        tie = i.isNotNull() | (F.col("n_features") <= last["n_features"])
    else:
        tie = F.coalesce((i < last["id"]) | ((i == last["id"]) & (F.col("n_features") <= last["n_features"])), F.lit(False))
    return rows.where(_eligible(min_words) & ((score > last["score"]) | ((score == last["score"]) & tie)))
