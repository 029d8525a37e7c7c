"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into 16 segments of 4 bits; the bit counts of the segments are a point of a 16-dimensional
grid. One differing bit moves that point by 1 in one dimension, so the Manhattan distance of two points is a lower
bound of the fingerprints' Hamming distance. The range join under that bound is made linear: points within distance
2 meet in a grid cell at distance 1 or less of both, so every fingerprint posts itself to the 33 cells around it
at most, and only cells that hold two or more fingerprints go on. There the exact check follows the same rule in
Hamming space: fingerprints x, y differ in at most two bits if and only if some z differs in at most one bit from
each; the members of a cell post to their z of that cell, and everybody at one z is a true link. A z has 65 members
at most, whatever the size of a group, so a star to the smallest member loses no link and no pairs are listed.

Links make components by contracting label pairs; lineage is cut in the shared checkpoint folder, and neither
links nor labels come to the driver.

Defined results: null or empty text and text of white space have fingerprint zero, linked like any other; a null doc_id gets the
component of its fingerprint, and does not count as a component's smallest; repeated rows come back each; an empty
table gives an empty result; further columns don't matter. Whole texts are hashed, in blocks of bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fusemill.llm.common import ROW, boxed, cut, named, row_hash, stored, unboxed

SEGMENTS, WIDTH = 16, 4
_BLOCK = 1 << 18  # shingles counted at a time


def fingerprint_of(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a text as a signed 64-bit integer."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
        total = 1
    else:
        parts = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
        total = len(words) - shingle + 1
    hashes = map(xxhash.xxh64_intdigest, parts, repeat(seed))
    counts = np.zeros(64, dtype=np.int64)
    for done in range(0, total, _BLOCK):
        block = np.fromiter(hashes, dtype=np.uint64, count=min(_BLOCK, total - done))
        bits = np.unpackbits(block.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    value = sum(1 << k for k in range(64) if 2 * counts[k] > total)
    return value - (1 << 64) if value >> 63 else value


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([fingerprint_of(t) for t in texts], dtype="int64")


def fingerprint(text: Column) -> Column:
    """Signed 64-bit SimHash of three-word shingles (Arrow batches; xxHash64, seed 42)."""
    return F.pandas_udf(_fingerprints, "long")(text)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _popcount(value: Column) -> Column:
    return F.bit_count(value).cast("long")


def grid_point(fp: Column) -> Column:
    """The segments' bit counts, 3 bits each, in one long."""
    out = F.lit(0).cast("long")
    for s in range(SEGMENTS):
        nibble = F.shiftrightunsigned(fp, s * WIDTH).bitwiseAND(F.lit(15).cast("long"))
        out = out.bitwiseOR(F.shiftleft(_popcount(nibble), 3 * s))
    return out


def _flips(fp: Column) -> Column:
    """Array of (cell, z): the fingerprint itself and its 64 one-bit neighbours, with their grid cells."""
    own = F.struct(F.col("_point").alias("cell"), fp.alias("z"))

    def neighbour(k: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        step = F.call_function("shiftleft", F.lit(1).cast("long"), F.floor(k / F.lit(WIDTH)).cast("int") * 3)
        was_set = fp.bitwiseAND(bit) != 0
        return F.struct(F.when(was_set, F.col("_point") - step).otherwise(F.col("_point") + step).alias("cell"), fp.bitwiseXOR(bit).alias("z"))

    return F.concat(F.array(own), F.transform(F.sequence(F.lit(0), F.lit(63)), neighbour))


def links(fps: DataFrame, fp: str = "fp") -> DataFrame:
    """Edges (src, dst), src < dst, that connect all distinct fingerprints at two or fewer differing bits.

    Two fingerprints that differ in at most two bits are connected through a star, not always by an edge of
    their own; every edge is a true link.
    """
    distinct = fps.select(F.col(fp).alias("fp")).where(F.col("fp").isNotNull()).distinct()
    # a fingerprint becomes some thirty rows, so the few bytes are dealt to all tasks first
    width = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(distinct.repartition(width, "fp").withColumn("_point", grid_point(F.col("fp"))))
    posts = placed.select("fp", F.explode(F.array_distinct(F.transform(_flips(F.col("fp")), lambda x: x["cell"]))).alias("cell"))
    # min and max tell a cell of one fingerprint from a shared one
    shared = posts.groupBy("cell").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a < b").select("cell")
    pairs = posts.join(shared, "cell", "left_semi")
    here = F.filter(_flips(F.col("fp")), lambda x: x["cell"] == F.col("cell"))
    near = pairs.withColumn("_point", grid_point(F.col("fp"))).select("fp", F.explode(F.transform(here, lambda x: x["z"])).alias("z"))
    # a z has 65 members at most: itself and its one-bit neighbours
    stars = near.groupBy("z").agg(F.collect_set("fp").alias("members")).where(F.size("members") > 1)
    edges = stars.select(F.array_min("members").alias("src"), F.explode("members").alias("dst"))
    return edges.where("src < dst").distinct()


def _looked_up(jump: DataFrame) -> DataFrame:
    further = jump.select(F.col("old").alias("new"), F.col("new").alias("last"))
    return jump.join(further, "new", "left").select("old", F.coalesce("last", "new").alias("new"), (F.col("last") < F.col("new")).alias("moved"))


def _followed(jump: DataFrame) -> DataFrame:
    """(old, new) with every chain of new labels followed to its end."""
    moved = True
    while moved:
        jump = stored(_looked_up(_looked_up(jump).drop("moved")))
        moved = not jump.where("moved").isEmpty()
        jump = jump.drop("moved")
    return jump


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of ``edges``; the label is the component's smallest node.

    Rounds of contraction: every label takes the smallest label next to it, chains are followed to their end by looking a label's own
    new label up until none changes, and edges inside one label go, until none is left. A label that stays is smaller than all next to it, so each round leaves half of an open component's
    labels at most, and its lookups double the reach: an ordered chain of n nodes takes one round of log n lookups. Each round's tables are written: a checkpoint would keep the planner's
    guess of its size, and guesses of joins over guesses grow to numbers that take longer to multiply than the join takes to run.
    """
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    labels = stored(nodes.withColumn("label", F.col("node")))
    rest = stored(edges.select("src", "dst"))
    while not rest.isEmpty():
        both = rest.select("src", "dst").union(rest.select(F.col("dst"), F.col("src")))
        jump = cut(both.groupBy("src").agg(F.min("dst").alias("near")).select(F.col("src").alias("old"), F.least("src", "near").alias("new")))
        jump = _followed(jump)
        renamed = jump.select(F.col("old").alias("label"), "new")
        labels = stored(labels.join(renamed, "label", "left").select("node", F.coalesce("new", "label").alias("label")))
        a, b = jump.select(F.col("old").alias("src"), F.col("new").alias("a")), jump.select(F.col("old").alias("dst"), F.col("new").alias("b"))
        moved = rest.join(a, "src").join(b, "dst").where("a <> b")
        rest = stored(moved.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
    return labels


def fingerprint_classes(marked: DataFrame, fp: str = "fp") -> DataFrame:
    """(fp, label): each distinct fingerprint with the smallest fingerprint it reaches."""
    distinct = marked.select(F.col(fp).alias("fp")).where(F.col("fp").isNotNull()).distinct()
    labels = components(links(distinct)).select(F.col("node").alias("fp"), "label")
    return distinct.join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, fp (long) and component_id, the smallest id that links reach."""
    marked = cut(docs.select(named(id_col).alias("_id"), fingerprint(named(text_col)).alias("fp")))
    smallest = marked.groupBy("fp").agg(F.min("_id").alias("low"))
    classes = cut(fingerprint_classes(marked).join(smallest, "fp"))
    lowest = classes.groupBy("label").agg(F.min("low").alias("component_id"))
    by_fp = classes.select("fp", "label").join(lowest, "label").select("fp", "component_id")
    return marked.join(by_fp, "fp").select(F.col("_id").alias(id_col), "fp", "component_id")


def row_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """What tells rows apart: id and text."""
    return F.concat_ws("|", F.coalesce(named(id_col).cast("string"), F.lit("-")), F.hex(F.xxhash64(F.coalesce(named(text_col), F.lit("")))))


def only(docs: DataFrame, key: Column, kept: DataFrame) -> DataFrame:
    """One row of each ``_key`` in ``kept``; of rows that differ elsewhere, the one of the smallest hash of all it holds."""
    keyed = docs.select(boxed(docs), key.alias("_key"), row_hash(docs).alias("tie")).join(kept, "_key", "left_semi")
    return unboxed(keyed.groupBy("_key").agg(F.min_by(ROW, "tie").alias(ROW)), docs.columns)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near-duplicates: of each component the row of the smallest id (rows of a null id
    last, then the smaller hash of the text) stays, once. Columns as they came."""
    key = row_key(docs, id_col, text_col)
    marked = cut(docs.select(key.alias("_key"), named(id_col).alias("_id"), fingerprint(named(text_col)).alias("fp")))
    order = lambda: F.struct(F.isnull("_id").alias("n"), F.col("_id").alias("i"), F.col("_key").alias("k"))
    first = marked.groupBy("fp").agg(F.min(order()).alias("first"))
    kept = fingerprint_classes(marked).join(first, "fp").groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.k").alias("_key"))
    return only(docs, key, kept)
