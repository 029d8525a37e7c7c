"""Approximate nearest neighbours by balanced posting lists.

Fit: k-means on a bounded sample (``sample_rows``, rows of small id hashes) makes one list for each ``list_rows`` rows of the table, a fourth of the
sample's rows at most; clusters of over twice the mean size are split until none is left, so that lists are balanced. A neighbour graph over the centroids
stays in memory and is searched best first. Every vector is put on the lists of its nearest centroid and of up to ``replicas`` - 1 further ones within
``closure`` times that distance (boundary vectors). A query visits the lists whose centroid is within a ratio of the nearest one's
distance: its walk over the graph ends when no centroid within that ratio is left unexpanded. The ratio is the smallest that reaches ``target_recall`` on
queries within the sample; if none does, all lists are visited.

Scale: the index (centroids and graph) is bounded by parameter and travels with the tasks. Lists grow in number with the table up to that bound, so that a
query reads about as many rows at any size below it; beyond, raise ``sample_rows``. Lists and the queries that visit them are cut into blocks of about
``block_rows``, and one task group is one block of vectors against one block of queries, so that a hot list is spread. A query's ``ahead_lists`` nearest lists
are searched first; of its other lists only what reaches the (k + 1)-th score found there is sent on, which loses nothing. Equal vectors are searched once: of a
vector's ids only the k + 1 smallest can be among anyone's k nearest (ties go to smaller ids, and the query's own id is the one that may drop
out), which bounds groups of copies exactly.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do those whose length
differs from the commonest length of the sample; null ids neither; a repeated (id, vector) row counts once; no vectors give no rows; fewer than k
candidates give all. Scores are computed pair by pair, in one order of summation, so they don't depend on blocks; equal scores go to smaller ids. Further
columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fusemill.llm.common import cut, named

#: Ratios beyond this one visit every list: two unit vectors are at a distance of 2 at most.
_ALL = 1e6


def usable(vector: Column) -> Column:
    """True for vectors that take part."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


@dataclass
class Index:
    centroids: np.ndarray  # unit rows
    graph: np.ndarray  # neighbours of each centroid
    ratio: float  # query pruning
    closure: float
    replicas: int
    least: float  # a distance to the nearest centroid below this counts as this

    def walk(self, x: np.ndarray, width: int, ratio: float = 0.0, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroids of unit rows ``x`` that a best-first walk over the graph meets: ids (-1: none) and distances, nearest first.

        A row's walk ends when its ``width`` nearest so far are expanded, or, with a ratio, those of them within it are.
        """
        n, lists = len(x), len(self.centroids)
        width = min(width, lists)
        entry = np.unique(np.linspace(0, lists - 1, min(lists, max(16, width))).astype(int))
        met = np.zeros((n, lists), dtype=bool)
        met[:, entry] = True
        ids = np.broadcast_to(entry, (n, len(entry))).copy()
        sims = x @ self.centroids[entry].T
        open_ = np.ones_like(ids, dtype=bool)
        out = np.full((n, width), -1), np.full((n, width), -np.inf)
        rows = np.arange(n)
        while True:
            top = np.argsort(-sims, axis=1, kind="stable")[:, :width]
            ids, sims, open_ = (np.take_along_axis(v, top, 1) for v in (ids, sims, open_))
            near = open_ & np.isfinite(sims)
            if ratio:
                near &= sims >= 1 - (ratio * np.maximum(np.sqrt(np.maximum(2 - 2 * sims[:, :1], 0)), self.least)) ** 2 / 2 - 1e-12
            go = near.any(1)
            out[0][rows[~go]], out[1][rows[~go]] = ids[~go], sims[~go]
            if not go.any():
                break
            rows, ids, sims, open_, near = rows[go], ids[go], sims[go], open_[go], near[go]
            at = np.arange(len(rows))[:, None]
            first = np.argsort(~near, axis=1, kind="stable")[:, :step]  # the nearest that are open
            node = np.take_along_axis(ids, first, 1)
            taken = np.take_along_axis(near, first, 1)
            np.put_along_axis(open_, first, ~taken & np.take_along_axis(open_, first, 1), 1)
            next_ = np.sort(self.graph[np.where(taken, node, node[:, :1])].reshape(len(rows), -1), axis=1)
            new = ~met[rows[:, None], next_]
            new[:, 1:] &= next_[:, 1:] != next_[:, :-1]
            met[rows[:, None], next_] = True
            value = np.where(new, np.einsum("nmd,nd->nm", self.centroids[next_], x[rows]), -np.inf)
            most = min(value.shape[1], width)
            best = np.argpartition(-value, most - 1, axis=1)[:, :most]
            ids, sims = np.hstack([ids, next_[at, best]]), np.hstack([sims, value[at, best]])
            open_ = np.hstack([open_, np.ones_like(best, dtype=bool)])
        return out[0], np.where(np.isfinite(out[1]), np.sqrt(np.maximum(0.0, 2 - 2 * np.where(np.isfinite(out[1]), out[1], 0))), np.inf)

    def lists_of(self, x: np.ndarray) -> list[np.ndarray]:
        """Lists of each stored vector: the nearest and, at a boundary, further ones."""
        out = []
        for a in range(0, len(x), 256):
            ids, d = self.walk(x[a : a + 256], self.replicas)
            ok = np.isfinite(d) & (d <= self.closure * np.maximum(d[:, :1], self.least))
            out += [i[o] for i, o in zip(ids, ok, strict=True)]
        return out

    def visits(self, x: np.ndarray, ratio: float | None = None) -> list[np.ndarray]:
        """Lists that each query visits: all whose centroid is within the ratio, as the walk meets them."""
        ratio, lists = ratio or self.ratio, len(self.centroids)
        if ratio >= _ALL:
            return [np.arange(lists)] * len(x)
        out = []
        for a in range(0, len(x), 64):
            part, width, found = x[a : a + 64], 128, [None] * len(x[a : a + 64])
            left = np.arange(len(part))
            while len(left):  # a walk whose width is full of lists within the ratio goes on with a greater one
                ids, d = self.walk(part[left], width, ratio, 16)
                ok = d <= ratio * np.maximum(d[:, :1], self.least) + 1e-12
                whole = ~ok.all(1) | (width >= lists)
                for r in np.flatnonzero(whole):
                    found[left[r]] = ids[r][ok[r]]
                left, width = left[~whole], width * 4
            out += found
        return out


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The centroid of greatest cosine of each row, in blocks: rows times lists would be a gigabyte."""
    return np.concatenate([(x[a : a + 1024] @ c.T).argmax(1) for a in range(0, len(x), 1024)])


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        sums = np.zeros_like(c)
        np.add.at(sums, _nearest(x, c), x)
        full = np.linalg.norm(sums, axis=1) > 1e-12
        c[full] = _unit(sums[full])
    return c, _nearest(x, c)


def fit(
    sample: np.ndarray,
    rows: int | None = None,
    list_rows: int = 4,
    replicas: int = 8,
    closure: float = 1.5,
    target_recall: float = 0.97,
    seed: int = 7,
) -> Index:
    """Index over the unit rows of ``sample``, for a table of ``rows`` rows."""
    rng = np.random.default_rng(seed)
    x = _unit(sample.astype(np.float64))
    most = max(1, len(x) // 4)
    k = max(1, min(most, (rows or len(x)) // list_rows))
    c, own = _kmeans(x, k, rng)
    order = np.argsort(own, kind="stable")
    pending = [x[part] for part in np.split(order, np.flatnonzero(np.diff(own[order])) + 1)]
    out, limit = [], max(8, 2 * len(x) // k)
    while pending:
        part = pending.pop()
        if len(part) > limit and len(out) + len(pending) + 2 <= 2 * most and np.ptp(part, axis=0).max() > 1e-12:
            _, half = _kmeans(part, 2, rng)
            if half.any() and not half.all():
                pending += [part[half == 0], part[half == 1]]
                continue
        out.append(_unit(part.mean(0, keepdims=True))[0] if np.linalg.norm(part.mean(0)) > 1e-12 else part[0])
    c = np.array(out)
    degree = min(len(c), 24)
    near = np.concatenate([np.argpartition(-(c[a : a + 1024] @ c.T), degree - 1, axis=1)[:, :degree] for a in range(0, len(c), 1024)])
    far = rng.integers(0, len(c), (len(c), 4))  # long links keep the graph connected
    at = rng.choice(len(x), min(200, len(x)), replace=False)
    # a vector of the sample may be a list of its own: the second nearest centroid tells what is near
    second = np.sort(x[at] @ c.T, axis=1)[:, -2:][:, 0]
    index = Index(c, np.concatenate([near, far], axis=1), _ALL, closure, replicas, max(1e-12, float(np.median(np.sqrt(np.maximum(0, 2 - 2 * second))))))
    sims = x[at] @ x.T
    sims[np.arange(len(at)), at] = -9
    truth = np.argsort(-sims, axis=1)[:, : min(5, len(x) - 1)]
    if truth.size:
        wanted, back = np.unique(truth, return_inverse=True)
        homes = index.lists_of(x[wanted])
        own = np.sqrt(np.maximum(0.0, 2 - 2 * (x[at] @ c.T)))
        own /= np.maximum(own.min(1, keepdims=True), index.least)
        # the ratio at which each true neighbour's nearest list is visited
        asked = np.array([[own[q, homes[t]].min() for t in back.reshape(truth.shape)[q]] for q in range(len(at))])
        index.ratio = float(np.quantile(asked, target_recall, method="higher")) + 1e-9
    return index


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def _posting(index: Index, queries: bool):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            out: list[list[int]] = []
            for a in range(0, len(v), 1024):
                x = _unit(_matrix(v.iloc[a : a + 1024]))
                out += [y.tolist() for y in (index.visits(x) if queries else index.lists_of(x))]
            yield pd.Series(out)

    return F.pandas_udf(run, "array<int>")


def _blocks(counts: dict[int, int], block_rows: int, n_lists: int) -> Column:
    """Literal array: number of blocks of each list."""
    return F.array(*[F.lit(max(1, -(-counts.get(k, 0) // block_rows))) for k in range(n_lists)])


def build(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = 20_000, **options) -> Index | None:
    """Fit the index on about ``sample_rows`` rows, those whose id hash is below a threshold; None without a usable vector."""
    fine = vectors.where(named(id_col).isNotNull() & usable(named(vector_col))).select(F.xxhash64(named(id_col)).alias("h"), named(id_col).alias("i"), named(vector_col).alias("v"))
    total = fine.count()
    # a threshold needs no sort: each row decides for itself, and the driver gets a bounded number
    share = min(1.0, 1.05 * sample_rows / max(1, total))
    rows = fine.where(F.pmod("h", F.lit(1 << 32)) <= int(share * (1 << 32))).limit(2 * sample_rows).collect()
    rows = sorted(rows, key=lambda r: (r["h"] % (1 << 32), r["i"], r["v"]))[:sample_rows]
    if not rows:
        return None
    lengths = pd.Series([len(r["v"]) for r in rows]).mode()
    return fit(np.array([r["v"] for r in rows if len(r["v"]) == lengths[0]], dtype=np.float64), total, **options)


def search(
    vectors: DataFrame, queries: DataFrame, index: Index | None, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 4096, ahead_lists: int = 8
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row of ``queries`` among ``vectors``, itself left out.

    score: cosine in double precision.
    """
    spark = vectors.sparkSession
    if index is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim, n_lists = index.centroids.shape[1], len(index.centroids)

    def valid(df: DataFrame) -> DataFrame:
        v = named(vector_col)
        return df.where(named(id_col).isNotNull() & usable(v) & (F.size(v) == dim)).select(named(id_col).cast("long").alias("id"), v.alias("v"))

    w = Window.partitionBy("v").orderBy("id")
    stored = valid(vectors).distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    stored = stored.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    posted = cut(stored.select("ids", "v", _posting(index, False)("v").alias("lists")))
    asked = valid(queries).distinct()
    heads = asked.groupBy("v").agg(F.min("id").alias("head"))
    probes = cut(heads.select("head", "v", _posting(index, True)("v").alias("lists")))

    count = lambda df: {r["l"]: r["count"] for r in df.select(F.explode("lists").alias("l")).groupBy("l").count().collect()}
    pb, qb = _blocks(count(posted), block_rows, n_lists), _blocks(count(probes), block_rows, n_lists)
    spread = lambda key, n: F.pmod(F.xxhash64(key), n.cast("long")).cast("int")
    each = lambda n: F.sequence(F.lit(0), n - 1)
    left = posted.select("ids", "v", F.explode("lists").alias("l"))
    left = left.select("ids", "v", "l", spread(F.col("ids"), F.get(pb, F.col("l"))).alias("b"), F.explode(each(F.get(qb, F.col("l")))).alias("q"))

    def asked_of(df: DataFrame, lists: Column, floor: Column) -> DataFrame:
        """Probes of the given lists, each met by all blocks of the list."""
        each_list = df.select("head", "v", floor.alias("floor"), F.explode(lists).alias("l"))
        return each_list.select("head", "v", "floor", "l", F.explode(each(F.get(pb, F.col("l")))).alias("b"), spread(F.col("head"), F.get(qb, F.col("l"))).alias("q"))

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        heads_, ids_, scores = [], [], []
        if len(a) and len(b):
            first = np.array([i[0] for i in a["ids"]])
            x, y = _matrix(a["v"]), _matrix(b["v"])
            nx, floor = np.sqrt((x * x).sum(1)), b["floor"].to_numpy()
            for s in range(0, len(y), 512):
                z = y[s : s + 512]
                nz = np.sqrt((z * z).sum(1))
                sims = (z @ x.T) / (nz[:, None] * nx[None, :])
                m = min(k + 1, len(x))
                kth = -np.partition(-sims, m - 1, axis=1)[:, m - 1]
                for r in range(len(z)):
                    c = np.flatnonzero(sims[r] >= max(kth[r], floor[s + r]) - 1e-9)
                    # a product of blocks may round as the block is cut; a row's own sum doesn't
                    score = (x[c] * z[r]).sum(1) / (nx[c] * nz[r])
                    order = np.lexsort((first[c], -score))[:m]
                    heads_ += [b["head"].iat[s + r]] * len(order)
                    ids_ += [a["ids"].iat[j] for j in c[order]]
                    scores += score[order].tolist()
        return pd.DataFrame({"head": pd.Series(heads_, dtype="int64"), "ids": pd.Series(ids_, dtype=object), "score": pd.Series(scores, dtype="float64")})

    key = ["l", "b", "q"]

    def found(right: DataFrame) -> DataFrame:
        got = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(nearest, "head bigint, ids array<bigint>, score double")
        # a vector on several lists is found several times
        return got.groupBy("head", F.element_at("ids", 1).alias("first")).agg(F.max("score").alias("score"), F.first("ids").alias("ids"))

    rank = Window.partitionBy("head").orderBy(F.desc("score"), "first")
    best_of = lambda df: df.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k + 1)
    # the nearest lists give each query a bound; the others send only what reaches it, so that a query costs few rows however many lists it visits
    ahead = cut(best_of(found(asked_of(probes, F.slice("lists", 1, ahead_lists), F.lit(-2.0)))))
    bounds = ahead.where(F.col("r") == k + 1).select("head", F.col("score").alias("bound"))
    rest = probes.where(F.size("lists") > ahead_lists).join(bounds, "head", "left")
    later = found(asked_of(rest, F.slice("lists", ahead_lists + 1, n_lists), F.coalesce("bound", F.lit(-2.0))))
    once = ahead.drop("r").unionByName(later).groupBy("head", "first").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    best = best_of(once)
    members = best.groupBy("head").agg(F.collect_list(F.struct("score", "ids")).alias("near"))
    rows = asked.join(heads, "v").select("id", "head").join(members, "head").select("id", F.explode("near").alias("n"))
    rows = rows.select("id", "n.score", F.explode("n.ids").alias("vec_id")).where(F.col("id") != F.col("vec_id"))
    order = Window.partitionBy("id").orderBy(F.desc("score"), "vec_id")
    return (
        rows.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
