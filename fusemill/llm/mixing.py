"""Mixing sources to target weights by Pfair scheduling.

The rows of each source, in an order given by a hash, are cut into blocks of ``block_rows``. With target weight w (a share of the blocks), block j
of a source is released at slot floor(j / w) and due at ceil((j + 1) / w); each slot goes to the released block that is due first. The windows
keep every source within less than one block of its weight's share of any prefix.

Weights are exact: integers, fractions, or floats, which stand for the simplest fraction that they are the nearest float of (1 / 3 is a third).
In whole numbers without a common factor they repeat after as many slots as their sum, so one period is scheduled from the weights alone and a block's
slot follows from its number, however long the mixture gets. Weights whose period is above ``max_period`` are refused; ``whole_weights``
rounds weights to a sum. When a source runs out, the rest goes on with its weights among themselves, as a new phase; so every row is placed
once, none is dropped or repeated, and the bound holds within each phase, from its first slot on.

Scale: rows are numbered within (source, hash bucket) of about ``bucket_rows`` rows, with offsets from the buckets' counts, so
that a hot source is spread over many tasks. The driver gets one row for each source. DataFrame functions only.

Defined results: a null source is a source of its own; null ids and repeated rows are placed each, rows of one id in the order of a hash of all they hold; an
empty table gives an empty result; texts don't matter, whatever their length; further columns pass under any name, and one named like an added column is
replaced. A source without a given weight gets the smallest given one; weights must be above 0. Without given weights, the targets are the
square roots of the sources' numbers of rows, in whole thousandths of their sum, one at least.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping
from fractions import Fraction
from numbers import Rational

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fusemill.llm.common import ROW, boxed, named, row_hash, unboxed

BLOCK_ROWS = 10
MAX_PERIOD = 50_000
#: The plan has at most (sources) ** 2 rows; beyond this many it is not broadcast.
BROADCAST_ROWS = 20_000

Weight = int | float | Fraction


def whole_weights(weights: Mapping[str | None, Weight], total: int = 1000) -> dict[str | None, int]:
    """Weights in whole parts of ``total`` (or of more, if there are more sources), each 1 at least, by largest remainders."""
    total = max(total, len(weights))
    whole = math.fsum(weights.values())
    spare = total - len(weights)
    exact = {s: spare * w / whole for s, w in weights.items()}
    out = {s: 1 + math.floor(x) for s, x in exact.items()}
    rest = total - sum(out.values())
    for s in sorted(exact, key=lambda s: (-(exact[s] - math.floor(exact[s])), str(s)))[:rest]:
        out[s] += 1
    return out


def exact(weight: Weight) -> Fraction:
    """The weight as a fraction; of a float, the one of the smallest denominator that is nearest to no other float."""
    if isinstance(weight, Rational):
        return Fraction(weight)
    bound = 1
    while float(Fraction(weight).limit_denominator(bound)) != weight:
        bound *= 2
    return Fraction(weight).limit_denominator(bound)


def integers(weights: Mapping[str | None, Fraction]) -> dict[str | None, int]:
    """Whole numbers without a common factor in the proportions of ``weights``."""
    scale = math.lcm(*[w.denominator for w in weights.values()])
    out = {s: int(w * scale) for s, w in weights.items()}
    common = math.gcd(*out.values())
    return {s: n // common for s, n in out.items()}


def schedule(share: Mapping[str | None, int]) -> dict[str | None, list[int]]:
    """Slots of each source in one period: earliest deadline first among the released blocks."""
    period = sum(share.values())
    order = sorted(share, key=lambda s: (s is not None, str(s)))
    out: dict[str | None, list[int]] = {s: [] for s in order}
    waiting = [(0, k) for k in range(len(order))]  # (release, source) of each source's next block
    ready: list[tuple[int, int]] = []  # (deadline, source)
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            k = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(len(out[order[k]]) + 1) * period // share[order[k]]), k))
        k = heapq.heappop(ready)[1]
        own = out[order[k]]
        own.append(t)
        if len(own) < share[order[k]]:
            heapq.heappush(waiting, (len(own) * period // share[order[k]], k))
    return out


def plan(blocks: Mapping[str | None, int], weights: Mapping[str | None, Fraction], max_period: int = MAX_PERIOD) -> list[dict]:
    """Rows (source, phase, from, until, base, share, period, slots): blocks from..until of a source go to
    base + period * (k div share) + slots[k mod share], with k counted from the phase's first block."""
    left = {s: n for s, n in blocks.items() if n > 0}
    used, base, out, phase = dict.fromkeys(left, 0), 0, [], 0
    while left:
        share = integers({s: weights[s] for s in left})
        size = sum(share.values())
        if size > max_period:
            raise ValueError(f"the weights repeat after {size} slots only; round them with whole_weights, or raise max_period above {max_period}")
        slots = schedule(share)
        place = lambda s, k: size * (k // share[s]) + slots[s][k % share[s]]  # noqa: B023, E731
        length = min(place(s, n - 1) for s, n in left.items()) + 1  # the phase ends with the first source's last block
        for s in list(left):
            whole, part = divmod(length, size)
            n = whole * share[s] + sum(x < part for x in slots[s])
            out.append({"source": s, "phase": phase, "from": used[s], "until": used[s] + n, "base": base, "share": share[s], "period": size, "slots": slots[s]})
            used[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        base += length
        phase += 1
    return out


def _starts(sizes: DataFrame, together: int = 1_000) -> DataFrame:
    """of_src, of_bucket, start: rows of the source in smaller buckets. Sums run within runs of ``together`` buckets and over the runs, so no window holds all buckets."""
    run = F.floor(F.col("of_bucket") / together).cast("int")
    before = lambda *keys: Window.partitionBy("of_src", *keys).rowsBetween(Window.unboundedPreceding, -1)
    each = sizes.withColumn("run", run)
    inside = each.withColumn("within", F.coalesce(F.sum("n").over(before("run").orderBy("of_bucket")), F.lit(0)))
    runs = each.groupBy("of_src", F.col("run").alias("of_run")).agg(F.sum("n").alias("n_run"))
    runs = runs.select(F.col("of_src").alias("run_src"), "of_run", F.coalesce(F.sum("n_run").over(before().orderBy("of_run")), F.lit(0)).alias("ahead"))
    met = inside.join(runs, F.col("of_src").eqNullSafe(F.col("run_src")) & (F.col("run") == F.col("of_run")))
    return met.select("of_src", "of_bucket", (F.col("within") + F.col("ahead")).alias("start"))


def _placed(
    docs: DataFrame,
    weights: Mapping[str | None, Weight] | None = None,
    source_col: str = "source",
    id_col: str = "doc_id",
    block_rows: int = BLOCK_ROWS,
    bucket_rows: int = 500,
    seed: int = 17,
    max_period: int = MAX_PERIOD,
) -> DataFrame:
    """The boxed rows with phase, slot, block and place."""
    spark = docs.sparkSession
    counts = {r["s"]: r["n"] for r in docs.groupBy(named(source_col).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if weights is None:
        weights = whole_weights({s: math.sqrt(n) for s, n in counts.items()}) if counts else {}
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be above 0")
    fractions = {s: exact(w) for s, w in weights.items()}
    given = {s: fractions.get(s, min(fractions.values(), default=Fraction(1))) for s in counts}
    rows = plan({s: -(-n // block_rows) for s, n in counts.items()}, given, max_period)
    kind = docs.schema[source_col].dataType.simpleString()
    schema = f"to_source {kind}, phase int, from_block bigint, until_block bigint, base bigint, share int, period int, slots array<int>"
    planned = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    buckets = max(1, -(-sum(counts.values()) // bucket_rows))
    # a hash of the whole row stands in for a null id, so that such rows are spread, too
    order = F.when(F.col("id").isNull(), F.xxhash64("tie", F.lit(seed))).otherwise(F.xxhash64("id", F.lit(seed)))
    keyed = docs.select(boxed(docs), named(source_col).alias("src"), named(id_col).alias("id"), row_hash(docs).alias("tie"))
    keyed = keyed.withColumn("h", order).withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    sizes = keyed.groupBy(F.col("src").alias("of_src"), F.col("bucket").alias("of_bucket")).agg(F.count(F.lit(1)).alias("n"))
    starts = _starts(sizes)
    numbered = keyed.withColumn("r", F.row_number().over(Window.partitionBy("src", "bucket").orderBy("h", "id", "tie"))).drop("h", "id", "tie")
    numbered = numbered.join(starts, F.col("src").eqNullSafe(F.col("of_src")) & (F.col("bucket") == F.col("of_bucket")))
    numbered = numbered.withColumn("seq", F.col("start") + F.col("r") - 1)
    numbered = numbered.select(ROW, "src", F.floor(F.col("seq") / block_rows).cast("long").alias("block"), F.pmod("seq", F.lit(block_rows)).cast("int").alias("place"))
    planned = F.broadcast(planned) if len(rows) <= BROADCAST_ROWS else planned
    same = F.col("src").eqNullSafe(F.col("to_source")) & (F.col("block") >= F.col("from_block")) & (F.col("block") < F.col("until_block"))
    k = F.col("block") - F.col("from_block")
    slot = F.col("base") + F.col("period") * F.floor(k / F.col("share")) + F.get("slots", F.pmod(k, F.col("share")).cast("int"))
    return numbered.join(planned, same).select(ROW, "phase", slot.cast("long").alias("slot"), "block", "place")


def mix(docs: DataFrame, weights: Mapping[str | None, Weight] | None = None, **options) -> DataFrame:
    """Input columns plus phase, slot (of the block, from 0), block (of the source, from 0) and place (within the block)."""
    made = {c: F.col(c) for c in ("phase", "slot", "block", "place")}
    return unboxed(_placed(docs, weights, **options), docs.columns, **made)


def position(block_rows: int = BLOCK_ROWS) -> Column:
    """A mixed row's place in the whole order, ascending by slot and place, without two rows alike; the last block of a source may leave gaps."""
    return F.col("slot") * block_rows + F.col("place")


def in_order(mixed: DataFrame) -> DataFrame:
    """Rows in order of slot and place, over partitions that each hold a run of it."""
    return mixed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place")


def ordered(docs: DataFrame, column: str, weights: Mapping[str | None, Weight] | None = None, block_rows: int = BLOCK_ROWS, **options) -> DataFrame:
    """Input columns plus the row's position under the name ``column``, laid out in that order."""
    laid = in_order(_placed(docs, weights, block_rows=block_rows, **options))
    return unboxed(laid, docs.columns, **{column: position(block_rows)})
