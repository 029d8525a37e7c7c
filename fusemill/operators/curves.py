"""Weight curves as arrays: arg-max plateaus, intervals, regret and losses. curve and grid have one length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tied(curve: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Bins (from 0) that are as good as the greatest."""
    top = F.array_max(curve)
    marked = F.transform(curve, lambda x, i: F.when(F.abs(x - top) <= atol + rtol * F.abs(top), i))
    return F.array_compact(marked)


def intervals(curve: Column, grid: Column) -> Column:
    """Closed weight ranges of neighbouring tied bins: array of (lo, hi)."""
    bins = tied(curve)
    starts = F.filter(bins, lambda i: ~F.array_contains(bins, i - 1))
    ends = F.filter(bins, lambda i: ~F.array_contains(bins, i + 1))
    return F.zip_with(starts, ends, lambda a, b: F.struct(F.get(grid, a).alias("lo"), F.get(grid, b).alias("hi")))


def distance(weight: Column, ranges: Column) -> Column:
    """Distance of a weight to the nearest range; null without ranges."""
    return F.array_min(F.transform(ranges, lambda r: F.greatest(r["lo"] - weight, weight - r["hi"], F.lit(0.0))))


def hits(weight: Column, ranges: Column) -> Column:
    return F.exists(ranges, lambda r: (weight >= r["lo"] - 1e-15) & (weight <= r["hi"] + 1e-15))


def mean_midpoint(ranges: Column) -> Column:
    total = F.aggregate(ranges, F.lit(0.0), lambda s, r: s + (r["lo"] + r["hi"]) / 2)
    return F.try_divide(total, F.size(ranges).cast("double"))


def plateau_midpoint(curve: Column, grid: Column, epsilon: float) -> Column:
    """Middle of the unbroken run of bins within ``epsilon`` of the top around its first place."""
    top = F.array_max(curve)
    first = (F.array_position(curve, top) - 1).cast("int")
    low = F.transform(curve, lambda x, i: F.when(x < top - epsilon, i))
    left = F.coalesce(F.array_max(F.filter(low, lambda i: i < first)) + 1, F.lit(0))
    right = F.coalesce(F.array_min(F.filter(low, lambda i: i > first)) - 1, F.size(curve) - 1)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.get(grid, left) + F.get(grid, right)) / 2))


def group_of(mid: Column, n: int = 5) -> Column:
    """Equal-width bucket of a midpoint."""
    return F.least(F.lit(n - 1), F.floor(mid * n + 1e-9)).cast("int")


def interpolate(curve: Column, weight: Column) -> Column:
    """Value of an evenly spaced curve at ``weight``, linear between bins."""
    last = F.size(curve) - 1
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight)) * last
    lo = F.least(F.floor(x).cast("int"), last)
    hi = F.least(lo + 1, last)
    return F.get(curve, lo) + (x - lo) * (F.get(curve, hi) - F.get(curve, lo))


def nearest_value(curve: Column, grid: Column, weight: Column) -> Column:
    """Value at the grid point nearest to ``weight``; the first of equal ones."""
    gaps = F.transform(grid, lambda g: F.abs(g - weight))
    return F.get(curve, (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int"))


def regret(curve: Column, weight: Column) -> Column:
    return F.array_max(curve) - interpolate(curve, weight)


def hinge_squared(curve: Column, weight: Column, epsilon: float = 0.0) -> Column:
    return F.pow(F.greatest(regret(curve, weight) - epsilon, F.lit(0.0)), F.lit(2.0))


def centroid(curve: Column, grid: Column) -> Column:
    """Score-weighted mean weight; without any mass the first weight."""
    mass = F.transform(curve, lambda s: F.greatest(s, F.lit(0.0)))
    total = F.aggregate(mass, F.lit(0.0), lambda a, s: a + s)
    lean = F.aggregate(F.zip_with(mass, grid, lambda s, w: s * w), F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(F.try_divide(lean, total), F.get(grid, F.lit(0)))


def spread(curve: Column) -> Column:
    """Population standard deviation."""
    n = F.size(curve).cast("double")
    mean = F.aggregate(curve, F.lit(0.0), lambda a, x: a + x) / n
    return F.sqrt(F.aggregate(F.transform(curve, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / n)


def mid_band_wins(curve: Column, grid: Column, lo: float = 0.2, hi: float = 0.8) -> Column:
    """The best inside [lo, hi] beats the best of either tail."""
    pairs = F.zip_with(curve, grid, lambda s, w: F.struct(s.alias("s"), w.alias("w")))
    best = lambda test: F.array_max(F.transform(F.filter(pairs, test), lambda p: p["s"]))
    mid = best(lambda p: (p["w"] >= lo - 1e-12) & (p["w"] <= hi + 1e-12))
    left, right = best(lambda p: p["w"] < lo - 1e-12), best(lambda p: p["w"] > hi + 1e-12)
    return (mid > F.coalesce(left, F.lit(float("-inf")))) & (mid > F.coalesce(right, F.lit(float("-inf"))))


def all_near(curve: Column, value: float, tolerance: float = 1e-15) -> Column:
    return F.forall(curve, lambda x: F.abs(x - value) <= tolerance)
