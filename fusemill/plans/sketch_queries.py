"""Sketches of ``events`` by day and type, merged to types and to all; each estimate is held against the exact value within its bound."""

from __future__ import annotations

from pyspark.sql import functions as F

from fusemill.operators import sketches
from fusemill.registry import register
from fusemill.sources.tables import table

RANKS = [0.05, 0.25, 0.5, 0.75, 0.95]


def band():
    """Heavy hitters are looked for among bands of value."""
    return F.floor(F.col("value") / 5).cast("long")


def levels(spark, sf_dir):
    """Events and their sketches by (day, type), type, and all."""
    e = table(spark, sf_dir, "events")
    fine = sketches.daily(e, {"day": F.to_date("ts"), "event_type": F.col("event_type")}, F.col("user_id"), F.col("value"), band())
    by_type = sketches.rolled(fine, ["event_type"])
    return e, by_type, sketches.rolled(by_type, [])


@register("sketch_members", "SELECT event_type, count(DISTINCT user_id) AS users, true AS hll_holds, true AS theta_holds FROM events GROUP BY 1 UNION ALL SELECT 'all', count(DISTINCT user_id), true, true FROM events")
def sketch_members(spark, sf_dir):
    """Exact numbers of users, and whether the merged estimates are within four standard errors of them."""
    e, by_type, every = levels(spark, sf_dir)
    exact = e.groupBy("event_type").agg(F.count_distinct("user_id").alias("users")).unionByName(e.agg(F.count_distinct("user_id").alias("users")).withColumn("event_type", F.lit("all")))
    got = sketches.members(by_type, ["event_type"]).unionByName(sketches.members(every.withColumn("event_type", F.lit("all")), ["event_type"]))
    holds = lambda c, error: F.abs(F.col(c) - F.col("users")) <= 4 * error * F.col("users") + 1
    return exact.join(got, "event_type").select("event_type", "users", holds("by_hll", 1.04 / 64).alias("hll_holds"), holds("by_theta", 1 / 64).alias("theta_holds"))


@register("sketch_quantiles", f"SELECT event_type, r AS rank, true AS holds FROM (SELECT DISTINCT event_type FROM events), (SELECT unnest({RANKS}::DOUBLE[]) AS r)")
def sketch_quantiles(spark, sf_dir):
    """Whether the true ranks of each estimated quantile's value hold the rank asked for, within the sketch's error."""
    e, by_type, _ = levels(spark, sf_dir)
    asked = sketches.quantiles(by_type, ["event_type"], RANKS).select("event_type", F.explode(F.arrays_zip(F.array(*map(F.lit, RANKS)).alias("rank"), "quantiles")).alias("q")).select("event_type", "q.rank", F.col("q.quantiles").alias("at"))
    ends = asked.groupBy("event_type").agg(F.map_from_entries(F.collect_list(F.struct("rank", "at"))).alias("at"))
    tallies = [f(F.when(test(F.col("value"), F.try_element_at("at", F.lit(r))), 1)).alias(f"{name}_{k}") for k, r in enumerate(RANKS) for name, f, test in (("below", F.count, lambda v, x: v < x), ("upto", F.count, lambda v, x: v <= x))]
    met = e.where("value IS NOT NULL").join(F.broadcast(ends), "event_type").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), *tallies)
    rows = F.array(*[F.struct(F.lit(r).alias("rank"), ((F.col(f"below_{k}") <= (r + sketches.KLL_ERROR) * F.col("n")) & (F.col(f"upto_{k}") >= (r - sketches.KLL_ERROR) * F.col("n"))).alias("holds")) for k, r in enumerate(RANKS)])
    return met.select("event_type", F.explode(rows).alias("r")).select("event_type", "r.*")


@register(
    "sketch_heavy",
    "WITH c AS (SELECT event_type, CAST(floor(value / 5) AS BIGINT) AS band, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2) SELECT event_type, band, n, true AS holds FROM c QUALIFY n > 0.025 * sum(n) OVER (PARTITION BY event_type)",
)
def sketch_heavy(spark, sf_dir):
    """Bands of value with more than a fortieth of a type's events, exactly, and whether the merged counters' bounds hold their number: none may be missing."""
    e, by_type, _ = levels(spark, sf_dir)
    n = e.where("value IS NOT NULL").groupBy("event_type", band().alias("band")).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("event_type").agg(F.sum("n").alias("total"))
    exact = n.join(total, "event_type").where(F.col("n") > 0.025 * F.col("total"))
    got = sketches.heavy(by_type, ["event_type"], 0.025).withColumnRenamed("item", "band")
    return exact.join(got, ["event_type", "band"], "left").select("event_type", "band", "n", F.coalesce(F.col("n").between(F.col("least"), F.col("most")), F.lit(False)).alias("holds"))
