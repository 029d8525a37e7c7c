"""Points in intervals, overlapping intervals and nearest points, by equi-joins on bins instead of comparisons of all with all.

An interval is dealt to the bins of its own level: the width of a level's bins is ``least`` times a power of two, the smallest that isn't shorter than the interval, so that every interval lies in two bins at most
whether it is short or long. A point has one bin on each level that occurs, and so meets an interval once at most; what meets is compared exactly. Pairs met are within a small
factor of the pairs returned, and a frequent bin is an ordinary join key that AQE may split.

Nearest points: rows of a key are cut into time bins of about ``bin_rows`` rows, each sorted on its own; the last and first point of every bin, a small table, bridge the bins without one. So a key
that holds most rows is spread over many tasks.

Counts don't make the pairs. ``others_within`` ranks the distinct times, cuts them into even blocks and answers an interval from its two outer blocks and a table of a row a block.
``overlap_counts`` lets blocks of keys meet in pairs and marks in a matrix of bits, while the starts and ends go by in time, which keys were open at which key's start: time goes with the square of the
keys, a bit each, memory and a task's work are bounded.

Defined results: ends belong to their interval; intervals with a null end or a start after their end, and null points, take no part; null keys meet nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fusemill.sources import artifacts

#: Instants of a block in ``others_within``, and keys of a block in ``overlap_counts``.
INSTANTS, KEYS = 1 << 16, 1 << 14
_NONE = np.iinfo(np.int64).max


def _level(start: Column, end: Column, least: float) -> Column:
    length = (end - start).cast("double") / F.lit(float(least))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length, F.lit(1.0)))).cast("int"))
    # a logarithm may round: the width is compared itself
    return F.when(F.pow(F.lit(2.0), level.cast("double")) < length, level + 1).otherwise(level)


def _bin(at: Column, level: Column, least: float) -> Column:
    return F.floor(at.cast("double") / (F.pow(F.lit(2.0), level.cast("double")) * F.lit(float(least)))).cast("long")


def contained(points: DataFrame, intervals: DataFrame, least: float = 1.0, keys: list[str] | None = None) -> DataFrame:
    """Columns of both for every point in an interval. points: at (a number) and more; intervals: start, end and more; ``keys``, columns of both, must be equal. No other column may be in both."""
    keys = keys or []
    spans = intervals.where("start <= end").withColumn("_level", _level(F.col("start"), F.col("end"), least))
    levels = sorted(r[0] for r in spans.select("_level").distinct().collect())  # as many as a number has bits at most
    first, last = _bin(F.col("start"), F.col("_level"), least), _bin(F.col("end"), F.col("_level"), least)
    dealt = spans.withColumn("_bin", F.explode(F.sequence(first, last)))
    marks = points.where("at IS NOT NULL").withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    marks = marks.withColumn("_bin", _bin(F.col("at"), F.col("_level"), least))
    return marks.join(dealt, [*keys, "_level", "_bin"]).where("at BETWEEN start AND end").drop("_level", "_bin")


def overlapping(a: DataFrame, b: DataFrame, least: float = 1.0) -> DataFrame:
    """Every pair of an interval of ``a`` (id_a, start, end) and one of ``b`` (id_b, start, end) that share a point, once: id_a, id_b.

    Of two that overlap, the later start lies in the other one; equal starts count as the second's.
    """
    fine = lambda df: df.where("start <= end")
    a, b = fine(a), fine(b)
    starts_b = b.select("id_b", F.col("start").alias("at"))
    starts_a = a.select("id_a", F.col("start").alias("at"))
    one = contained(starts_b, a.select("id_a", "start", "end"), least).select("id_a", "id_b")
    two = contained(starts_a, b.select("id_b", "start", "end"), least).where("at > start").select("id_a", "id_b")
    return one.unionByName(two)


def nearest(left: DataFrame, right: DataFrame, key: str, bin_rows: int = 100_000) -> DataFrame:
    """Columns of ``left`` and near, the nearest ``at`` of ``right`` with the same key (the earlier of equally near ones; null without one). Both have key and at (a whole number)."""
    both = left.select(F.lit(1).alias("_side"), F.col(key), "at", F.struct(*left.columns).alias("_row")).unionByName(right.where("at IS NOT NULL").select(F.lit(0).alias("_side"), F.col(key), "at"), allowMissingColumns=True)
    known = both.where(F.col("at").isNotNull() & F.col(key).isNotNull())
    n, lo, hi = known.agg(F.count(F.lit(1)), F.min("at"), F.max("at")).first()
    width = max(1, ((hi or 0) - (lo or 0)) * bin_rows // max(1, n))
    known = known.withColumn("_bin", F.floor((F.col("at") - F.lit(lo or 0)) / F.lit(width)).cast("long"))
    own = F.when(F.col("_side") == 0, F.col("at"))
    here = Window.partitionBy(key, "_bin").orderBy("at", "_side")
    back = Window.partitionBy(key, "_bin").orderBy(F.desc("at"), "_side")
    marked = known.withColumn("_before", F.max(own).over(here)).withColumn("_after", F.min(own).over(back)).where("_side = 1")
    ends = known.groupBy(key, "_bin").agg(F.max(own).alias("_max"), F.min(own).alias("_min"))
    past = Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    future = Window.partitionBy(key).orderBy("_bin").rowsBetween(1, Window.unboundedFollowing)
    bridges = ends.select(key, "_bin", F.max("_max").over(past).alias("_past"), F.min("_min").over(future).alias("_future"))
    met = marked.join(bridges, [key, "_bin"])
    before, after = F.coalesce("_before", "_past"), F.coalesce("_after", "_future")
    near = F.when(after.isNull() | (F.col("at") - before <= after - F.col("at")), before).otherwise(after)
    odd = left.where(F.col("at").isNull() | F.col(key).isNull())
    return met.select("_row.*", F.coalesce(near, after).alias("near")).unionByName(odd.withColumn("near", F.lit(None).cast("long")))


def _merged(a: tuple, b: tuple) -> tuple:
    """Of two ranges of points: the smallest id, its key, and the smallest id of any other key."""
    left = a[0] <= b[0]
    second = np.where(left, np.minimum(a[2], np.where(b[1] == a[1], b[2], b[0])), np.minimum(b[2], np.where(a[1] == b[1], a[2], a[0])))
    return np.where(left, a[0], b[0]), np.where(left, a[1], b[1]), second


class _Ranges:
    """Number of points and the smallest id of other keys over ranges of positions."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.before = np.concatenate([[0], np.cumsum(rows["n"].to_numpy(dtype=np.int64))])
        self.levels = [tuple(rows[c].to_numpy(dtype=np.int64) for c in ("id", "by", "next_id"))]
        while 2 << (len(self.levels) - 1) <= len(rows):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(_merged(tuple(c[:-half] for c in last), tuple(c[half:] for c in last)))

    def ask(self, low: np.ndarray, high: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For low to high, ends included; nothing where low is greater."""
        n, first = np.zeros(len(low), dtype=np.int64), np.full(len(low), _NONE)
        size = high - low + 1
        n[size > 0] = (self.before[1:][high[size > 0]] if len(self.before) > 1 else 0) - self.before[low[size > 0]]
        for k, level in enumerate(self.levels):
            here = np.flatnonzero((size >= 1 << k) & (size < 2 << k))
            if len(here):
                a, b = low[here], high[here] - (1 << k) + 1
                got = _merged(tuple(c[a] for c in level), tuple(c[b] for c in level))
                first[here] = np.where(got[1] == key[here], got[2], got[0])
        return n, first


def others_within(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """key, start, n, first_id: how many points of other keys lie in each interval, and the smallest of their ids; intervals without one are left out.

    points: key, at, id; intervals: key, start, end, own (how many points of its key it holds), all whole numbers. An interval starts and ends at points of its key and has all of
    its key's points between. Null keys are nobody's and take no part; a null id is counted.
    """
    held = points.where("key IS NOT NULL AND at IS NOT NULL").groupBy("at", "key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    held = held.withColumn("id", F.coalesce("id", F.lit(int(_NONE))))
    turn = F.row_number().over(Window.partitionBy("at").orderBy("id", "key"))
    two = held.withColumn("_n", F.sum("n").over(Window.partitionBy("at"))).withColumn("_turn", turn).where("_turn <= 2")
    of = lambda k, c: F.max(F.when(F.col("_turn") == k, F.col(c)))
    instants = two.groupBy("at").agg(F.max("_n").alias("n"), of(1, "id").alias("id"), of(1, "key").alias("by"), F.coalesce(of(2, "id"), F.lit(int(_NONE))).alias("next_id"))
    instants = artifacts.cut(artifacts.numbered(instants, "at"))
    block, place = F.floor(F.col("row_id") / INSTANTS).cast("long"), (F.col("row_id") % INSTANTS).cast("long")
    placed = instants.select(block.alias("_block"), place.alias("_place"), "n", "id", "by", "next_id")
    # a row for INSTANTS times: the smallest id and the smallest of any other key
    lowest = placed.groupBy("_block").agg(F.sum("n").alias("n"), F.min_by(F.struct("id", "by"), F.struct("id", "by")).alias("m"))
    other = placed.join(lowest.select("_block", "m"), "_block").groupBy("_block").agg(F.min(F.when(F.col("by") != F.col("m.by"), F.col("id")).otherwise(F.col("next_id"))).alias("next_id"))
    summary = lowest.join(other, "_block").select("_block", "n", "m.id", "m.by", "next_id").orderBy("_block").toPandas()

    ends = instants.select("at", "row_id")
    ranged = intervals.where("key IS NOT NULL").join(ends.select(F.col("at").alias("start"), F.col("row_id").alias("_lo")), "start").join(ends.select(F.col("at").alias("end"), F.col("row_id").alias("_hi")), "end")
    part = lambda c: F.floor(F.col(c) / INSTANTS).cast("long")
    spot = lambda c: (F.col(c) % INSTANTS).cast("long")
    piece = lambda at, low, high, a, b: F.struct(at.alias("_block"), low.alias("_low"), high.alias("_high"), a.alias("_from"), b.alias("_to"))
    none, last = F.lit(0).cast("long"), F.lit(INSTANTS - 1).cast("long")
    one = F.array(piece(part("_lo"), spot("_lo"), spot("_hi"), none, none - 1))
    outer = F.array(piece(part("_lo"), spot("_lo"), last, part("_lo") + 1, part("_hi") - 1), piece(part("_hi"), none, spot("_hi"), none, none - 1))
    pieces = ranged.select("key", "start", "own", F.explode(F.when(part("_lo") == part("_hi"), one).otherwise(outer)).alias("p")).select("key", "start", "own", "p.*")

    def answered(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if asked.empty:
            return pd.DataFrame({"key": [], "start": [], "own": [], "n": [], "first_id": []})
        here, between, key = _Ranges(rows.sort_values("_place")), _Ranges(summary), asked["key"].to_numpy(dtype=np.int64)
        n, first = here.ask(asked["_low"].to_numpy(), asked["_high"].to_numpy(), key)
        m, further = between.ask(asked["_from"].to_numpy(), asked["_to"].to_numpy(), key)
        return asked[["key", "start", "own"]].assign(n=n + m, first_id=np.minimum(first, further))

    got = placed.groupBy("_block").cogroup(pieces.groupBy("_block")).applyInPandas(answered, "key long, start long, own long, n long, first_id long")
    summed = got.groupBy("key", "start").agg((F.sum("n") - F.max("own")).alias("n"), F.min("first_id").alias("first_id"))
    return summed.where("n > 0").withColumn("first_id", F.when(F.col("first_id") < F.lit(int(_NONE)), F.col("first_id")))


def _open_at_starts(a: tuple, b: tuple, n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits: keys of b open when one of a starts, and the other way round. a, b: start, end and key number of the intervals."""
    at = np.concatenate([a[0], b[0], a[1], b[1]])
    side = np.repeat([0, 1, 2, 3], [len(a[0]), len(b[0]), len(a[0]), len(b[0])])
    who = np.concatenate([a[2], b[2], a[2], b[2]])
    order = np.lexsort((side, at))  # at one time, starts come before ends
    met_a, met_b = np.zeros((n_a, (n_b + 7) // 8), dtype=np.uint8), np.zeros((n_b, (n_a + 7) // 8), dtype=np.uint8)
    open_a, open_b = bytearray(met_b.shape[1]), bytearray(met_a.shape[1])
    now_a, now_b, join = np.frombuffer(open_a, dtype=np.uint8), np.frombuffer(open_b, dtype=np.uint8), np.bitwise_or
    for low in range(0, len(order), 1 << 16):
        part = order[low : low + (1 << 16)]
        for s, k in zip(side[part].tolist(), who[part].tolist(), strict=True):
            if s & 1:
                open_b[k >> 3] ^= 128 >> (k & 7)
                if s == 1:
                    row = met_b[k]
                    join(row, now_a, row)
            else:
                open_a[k >> 3] ^= 128 >> (k & 7)
                if s == 0:
                    row = met_a[k]
                    join(row, now_b, row)
    return met_a, met_b


def _counted(rows: pd.DataFrame) -> pd.DataFrame:
    """key, n, keys within one pair of blocks."""
    first, second = rows["_i"].iloc[0], rows["_j"].iloc[0]
    sides = [rows[rows["_own"] == k].reset_index(drop=True) for k in dict.fromkeys([first, second])]
    flat = [(np.concatenate(s["starts"].tolist()), np.concatenate(s["ends"].tolist()), np.repeat(np.arange(len(s)), s["starts"].map(len))) if len(s) else None for s in sides]
    if any(f is None for f in flat):
        return pd.DataFrame({"key": [], "n": [], "keys": []})
    same = len(sides) == 1
    (x, y), (sx, sy) = (flat * 2)[:2], (sides * 2)[:2]
    bits_x, bits_y = _open_at_starts(x, y, len(sx), len(sy))
    keys_x, keys_y = np.zeros(len(sx), dtype=np.int64), np.zeros(len(sy), dtype=np.int64)
    for low in range(0, len(sx), 1024):
        high = min(low + 1024, len(sx))
        turned = np.unpackbits(bits_y[:, low // 8 : (high + 7) // 8], axis=1)[:, : high - low].T
        met = np.unpackbits(bits_x[low:high], axis=1)[:, : len(sy)] | turned
        if same:
            met[np.arange(high - low), np.arange(low, high)] = 0
        keys_x[low:high] = met.sum(axis=1, dtype=np.int64)
        keys_y += met.sum(axis=0, dtype=np.int64)

    def pairs(p: tuple, q: tuple, size: int) -> np.ndarray:
        begun, over = np.searchsorted(np.sort(q[0]), p[1], "right"), np.searchsorted(np.sort(q[1]), p[0], "left")
        return np.bincount(p[2], weights=begun - over - same, minlength=size).astype(np.int64)

    out = [pd.DataFrame({"key": sx["key"], "n": pairs(x, y, len(sx)), "keys": keys_x})]
    if not same:
        out.append(pd.DataFrame({"key": sy["key"], "n": pairs(y, x, len(sy)), "keys": keys_y}))
    return pd.concat(out)


def overlap_counts(intervals: DataFrame) -> DataFrame:
    """key, n, keys: with how many intervals of other keys, and of how many others, the key's intervals overlap; keys without any are left out.

    intervals: key, start, end (whole numbers); those of one key don't overlap each other. Null keys overlap nothing.
    """
    held = intervals.where("key IS NOT NULL AND start <= end").groupBy("key").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    held = artifacts.cut(held)
    blocks = max(1, -(-held.count() // KEYS))
    own = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
    dealt = held.withColumn("_own", own).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("key", "starts", "ends", "_own", F.least("_own", "_k").alias("_i"), F.greatest("_own", "_k").alias("_j"))
    met = dealt.groupBy("_i", "_j").applyInPandas(_counted, f"key {intervals.schema['key'].dataType.simpleString()}, n long, keys long")
    return met.groupBy("key").agg(F.sum("n").alias("n"), F.sum("keys").alias("keys")).where("n > 0")
