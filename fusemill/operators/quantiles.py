"""Exact quantiles by rank: histograms narrow the range that holds a rank until few rows are left, and only those are sorted.

Every pass counts the rows of each sought range in ``bins`` equal parts, with the least and greatest value of each part, and goes on with the parts that hold a sought rank. Each pass is one partial aggregation:
what is shuffled is a row a range and part, however many rows a key has, and no key's values are ever sorted as a whole. A part of equal values ends its search at once, so repeated values cost nothing.

Defined results: nulls and NaN take no part; a key without values gives no row; a rank's value is linear between its two neighbours; an infinite value is refused by its key's quantiles being null.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fusemill.checkpoint import shared_folder


def _written(df: DataFrame) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/ranks-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exact(rows: DataFrame, keys: list[str], value: Column, ranks: list[float], bins: int = 512, few: int = 10_000) -> DataFrame:
    """keys, n and quantiles: the values at ``ranks`` (0 to 1), linear between neighbours. keys must not be named like the working columns (v, k, lo, hi, before, bin)."""
    base = rows.select(*keys, value.cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    whole = base.groupBy(*keys) if keys else base.groupBy()
    ends = _written(whole.agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("n > 0"))
    place = lambda r: (F.col("n") - 1) * F.lit(float(r))
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(r)).cast("long"), F.ceil(place(r)).cast("long")) for r in ranks])))
    open_ = ends.where("abs(lo) < double('inf') AND abs(hi) < double('inf')").select(*keys, F.explode(wanted).alias("k"), "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("rows"))
    found = open_.where("lo = hi").select(*keys, "k", F.col("lo").alias("v"))
    parts = [found]
    open_ = _written(open_.where("lo < hi"))
    while (most := open_.agg(F.max("rows")).first()[0] or 0) > few:
        parts_of = _histogram(base, open_, keys, bins)
        cumulated = F.sum("n").over(Window.partitionBy(*keys, "lo", "hi").orderBy("bin"))
        steps = parts_of.withColumn("upto", cumulated)
        met = open_.alias("o").join(steps.alias("s"), _on(keys))
        k, before, upto = F.col("o.k"), F.col("o.before"), F.col("s.upto")
        inside = met.where((k >= before + upto - F.col("s.n")) & (k < before + upto))
        narrowed = _written(inside.select(*[F.col(f"o.{c}").alias(c) for c in keys], k.alias("k"), F.col("s.least").alias("lo"), F.col("s.most").alias("hi"), (before + upto - F.col("s.n")).alias("before"), F.col("s.n").alias("rows")))
        parts.append(narrowed.where("lo = hi").select(*keys, "k", F.col("lo").alias("v")))
        open_ = narrowed.where("lo < hi")
    if most:
        spans = open_.select(*keys, "lo", "hi", "before").distinct()
        own = base.alias("b").join(spans.alias("s"), _within(keys)).select(*[F.col(f"b.{c}").alias(c) for c in keys], F.col("b.v").alias("v"), *[F.col(f"s.{c}").alias(c) for c in ("lo", "hi", "before")])
        order = Window.partitionBy(*keys, "lo", "hi").orderBy("v")
        numbered = own.withColumn("at", F.col("before") + F.row_number().over(order) - 1)
        met = open_.alias("o").join(numbered.alias("s"), _on(keys) & (F.col("o.k") == F.col("s.at")))
        parts.append(met.select(*[F.col(f"o.{c}").alias(c) for c in keys], F.col("o.k").alias("k"), F.col("s.v").alias("v")))
    values = parts[0]
    for p in parts[1:]:
        values = values.unionByName(p)
    groups = values.groupBy(*keys) if keys else values.groupBy()
    lists = groups.agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("at"))
    both = ends.alias("e").join(lists.alias("l"), _on(keys, "e", "l", ranged=False), "left")
    n = F.col("e.n")

    def of(r: float) -> Column:
        at = (n - 1) * F.lit(float(r))
        lo, hi = F.floor(at).cast("long"), F.ceil(at).cast("long")
        a, b = F.try_element_at("l.at", lo), F.try_element_at("l.at", hi)
        return a + (at - lo) * (b - a)

    return both.select(*[F.col(f"e.{c}").alias(c) for c in keys], n.alias("n"), F.array(*map(of, ranks)).alias("quantiles"))


def _on(keys: list[str], a: str = "o", b: str = "s", ranged: bool = True) -> Column:
    out = (F.col(f"{a}.lo") == F.col(f"{b}.lo")) & (F.col(f"{a}.hi") == F.col(f"{b}.hi")) if ranged else F.lit(True)
    for k in keys:
        out &= F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def _within(keys: list[str]) -> Column:
    out = F.col("b.v").between(F.col("s.lo"), F.col("s.hi"))
    for k in keys:
        out &= F.col(f"b.{k}").eqNullSafe(F.col(f"s.{k}"))
    return out


def _histogram(base: DataFrame, open_: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """keys, lo, hi, bin, n, least, most: the rows of each sought range in ``bins`` equal parts."""
    spans = open_.select(*keys, "lo", "hi").distinct()
    met = base.alias("b").join(spans.alias("s"), _within(keys))
    part = F.least(F.floor((F.col("b.v") / 2 - F.col("s.lo") / 2) / (F.col("s.hi") / 2 - F.col("s.lo") / 2) * bins), F.lit(bins - 1)).cast("int")
    made = met.select(*[F.col(f"b.{c}").alias(c) for c in keys], F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"), part.alias("bin"), F.col("b.v").alias("v"))
    return made.groupBy(*keys, "lo", "hi", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
