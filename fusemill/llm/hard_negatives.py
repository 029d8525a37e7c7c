"""Hard-negative mining by a vantage-point tree over norm-augmented vectors.

Every vector x gets one more component, the root of M - |x| ** 2 with M the greatest squared norm of the table, and a query a zero: then |q - x| ** 2 = |q| ** 2 + M - 2 q x, so the largest inner
products are the nearest neighbours, and a window of scores is an annulus of distances around the query. An anchor's positives are its nearest rows of its own label; each positive
asks for the nearest rows of other labels within the annulus of its score window.

The tree has two levels. Its upper part is fitted on a bounded sample (``sample_rows``) and deals all rows to at most ``max_leaves`` leaves; for each leaf the true least and
greatest distance of all its rows to the vantage points above it are aggregated in Spark, so that the triangle inequality excludes a leaf safely whatever the sample was.
A leaf is cut into blocks of about ``block_rows`` rows, each with a vantage-point tree of its own over buckets of ``BUCKET`` rows, built once and written. Both levels are traversed nearest first:
a query is searched in its ``ahead`` nearest leaves first; the k-th score found there closes the annulus from outside, and only leaves that still reach into it are visited. Within a block the same
happens bucket by bucket, in rounds of 1, 2, 4, ... buckets a query. Nothing is left out but what the triangle inequality excludes, so results are exact.

Scale: the driver holds the sample and one row a leaf. Queries and blocks meet by (leaf, block, block of queries), so that neither a large leaf nor a popular one grows a task. Equal
vectors of one label are one point that keeps its ``k`` + 1 smallest ids (ties go to smaller ids, and the anchor's own id may drop out): groups of copies are bounded exactly, and anchors of equal vector
and label are searched once. No links between all rows are listed: anchors are a stated set.

Defined results: rows with a null id, label or vector, an empty vector, or null or non-finite components take no part, nor do those whose length differs from the sample's commonest
one; identical rows count once; "other" rows are those of another id; without anchors, positives or rows of other labels there are no rows; fewer than asked give all; a positive with a score below
zero has an empty window. Components have to be whole numbers (``quantised``) whose inner products stay below 2 ** 53: sums are then exact in doubles. Further columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fusemill.llm.common import cut, named, stored

#: Rows of a bucket, the smallest part of a block's tree.
BUCKET = 128
_FAR = 1 << 60


def quantised(vector: Column, steps: int = 256) -> Column:
    """floor(steps * x) of each component, in doubles."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * steps).cast("double"))


def usable(vector: Column) -> Column:
    """True for vectors that take part: with components, none of them null or non-finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, fine), F.lit(False))


@dataclass
class Tree:
    """Vantage points (augmented), and for each leaf the points above it with its rows' distances to them."""

    top: float  # greatest squared norm of the table
    points: np.ndarray
    radius: list[float] = field(default_factory=list)
    inside: list[int] = field(default_factory=list)  # the node of the rows within the radius; ~leaf if negative
    outside: list[int] = field(default_factory=list)
    path: np.ndarray = field(default_factory=lambda: np.zeros((1, 0), dtype=np.int64))
    least: np.ndarray = field(default_factory=lambda: np.zeros((1, 0)))
    most: np.ndarray = field(default_factory=lambda: np.zeros((1, 0)))

    @property
    def leaves(self) -> int:
        return len(self.path)

    def far(self, x: np.ndarray) -> np.ndarray:
        """Distances of stored rows (augmented) to all vantage points."""
        return np.sqrt(np.maximum(0.0, 2 * self.top - 2 * (x @ self.points.T)))

    def deal(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each stored row (augmented)."""
        at = np.zeros(len(x), dtype=np.int64) if self.radius else np.full(len(x), -1)
        d = self.far(x) if self.radius else None
        while (open_ := np.flatnonzero(at >= 0)).size:
            node = at[open_]
            near = d[open_, node] <= np.array(self.radius)[node]
            at[open_] = np.where(near, np.array(self.inside)[node], np.array(self.outside)[node])
        return ~at

    def scores(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that a row of each leaf can have with each query (plain vectors), by the triangle inequality."""
        if not self.path.shape[1]:
            return np.full((len(q), self.leaves), -float(_FAR)), np.full((len(q), self.leaves), float(_FAR))
        # a query stretched to the rows' sphere asks for the same rows, and is nearer to them
        length = np.sqrt((q * q).sum(1))[:, None]
        by = np.where(length > 0, np.sqrt(self.top) / np.maximum(length, 1e-300), 1.0)
        both = self.top + (by * length) ** 2
        d = np.sqrt(np.maximum(0.0, both - 2 * by * (q @ self.points[:, :-1].T)))[:, self.path]
        slack = 1e-6 * np.sqrt(both)
        near = np.maximum(0.0, np.maximum(d - self.most, self.least - d).max(2) - slack)
        away = (d + self.most).min(2) + slack
        return (both - away**2) / 2 / by, (both - near**2) / 2 / by


def augmented(x: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0.0, top - (x * x).sum(1)))[:, None]])


def grow(x: np.ndarray, top: float, leaf_rows: int) -> tuple[Tree, np.ndarray]:
    """A tree over augmented rows, halved at the median distance until leaves have ``leaf_rows`` rows or equal ones; and the leaf of each row."""
    points: list[np.ndarray] = []
    radius: list[float] = []
    child: list[list[int]] = []
    leaf = np.zeros(len(x), dtype=np.int64)
    paths: list[list[int]] = []
    bounds: list[tuple[list[float], list[float]]] = []
    pending = [(np.arange(len(x)), [], -1, 0)]  # rows, their distances to the points above, the node above and the side of it
    while pending:
        rows, above, parent, side = pending.pop()
        node = -1
        if len(rows) > leaf_rows:
            own = x[rows]
            v = own[np.argmin(own @ own[0])]  # the row farthest from the first: distances to it differ most
            d = np.sqrt(np.maximum(0.0, 2 * top - 2 * (own @ v)))
            r = float(np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2])
            if (d <= r).all():
                below = d[d < r]
                r = float(below.max()) if len(below) else -1.0
            if r >= 0:
                node = len(points)
                points.append(v)
                radius.append(r)
                child.append([0, 0])
                near = d <= r
                above = [(p, e) for p, e in above]
                for half, k in ((near, 0), (~near, 1)):
                    pending.append((rows[half], [(p, e[half]) for p, e in above] + [(node, d[half])], node, k))
        if node < 0:
            leaf[rows] = len(paths)
            node = ~len(paths)
            paths.append([p for p, _ in above])
            bounds.append(([float(e.min()) if len(e) else 0.0 for _, e in above], [float(e.max()) if len(e) else 0.0 for _, e in above]))
        if parent >= 0:
            child[parent][side] = node
    deep = max(map(len, paths))
    # shorter paths name their first point again
    pad = lambda rows: np.array([r + r[:1] * (deep - len(r)) for r in rows]).reshape(len(paths), deep)
    tree = Tree(top, np.array(points).reshape(len(points), x.shape[1]), radius, [c[0] for c in child], [c[1] for c in child], pad(paths).astype(np.int64))
    tree.least, tree.most = pad([b[0] for b in bounds]).astype(float), pad([b[1] for b in bounds]).astype(float)
    return tree, leaf


@dataclass
class Block:
    """Some rows of a leaf in the order of their tree's buckets."""

    x: np.ndarray
    label: np.ndarray
    first: np.ndarray  # smallest id of each row
    ids: list[list[int]]
    start: np.ndarray  # first row of each bucket, and the end
    tree: Tree

    def search(self, q: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """query, window, row and score: each window's first k rows of the query's label (``same``), or of others, with a score from ``low`` to ``high`` ([query, window])."""
        low = low.copy()
        least, most = self.tree.scores(q)
        order = np.argsort(-most, axis=1, kind="stable")
        none = np.zeros(0, dtype=np.int64)
        held = (none, none, np.zeros(0))
        alive, a, step = np.arange(len(q)), 0, 1
        kept = (none, none, none)
        while a < self.tree.leaves and len(alive):
            bucket = order[alive, a : a + step]
            who = np.repeat(alive, bucket.shape[1])
            bucket = bucket.ravel()
            need = ((most[who, bucket][:, None] >= low[who]) & (least[who, bucket][:, None] <= high[who]) & (low[who] <= high[who])).any(1)
            who, bucket = who[need], bucket[need]
            by = np.argsort(bucket, kind="stable")
            who, bucket = who[by], bucket[by]
            found = [held]
            for part in np.split(np.arange(len(who)), np.flatnonzero(np.diff(bucket)) + 1):
                if not len(part):
                    continue
                h, s, e = who[part], self.start[bucket[part[0]]], self.start[bucket[part[0]] + 1]
                score = self.x[s:e] @ q[h].T
                ok = (score >= low[h].min(1)) & (score <= high[h].max(1)) & ((self.label[s:e, None] == label[h]) == same)
                row, col = np.nonzero(ok)
                found.append((h[col], row + s, score[row, col]))
            who, row, score = (np.concatenate([f[j] for f in found]) for j in range(3))
            by = np.lexsort((self.first[row], -score, who))
            who, row, score = who[by], row[by], score[by]
            kept, low = self._best(who, score, low, high, k)
            use = np.unique(kept[0])
            held = (who[use], row[use], score[use])
            kept = (np.searchsorted(use, kept[0]), kept[1], kept[2])
            a += step
            step *= 2
            if a < self.tree.leaves:
                alive = alive[(most[alive, order[alive, a]][:, None] >= low[alive]).any(1)]
        at, window, _ = kept
        return held[0][at], window, held[1][at], held[2][at]

    @staticmethod
    def _best(who: np.ndarray, score: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        """Candidates (sorted by query, best first) that are among the first k of a window; and the windows' low ends, raised to the k-th score."""
        at, windows, places = [], [], []
        low = low.copy()
        for j in range(low.shape[1]):
            c = np.flatnonzero((score >= low[who, j]) & (score <= high[who, j]))
            own = who[c]
            fresh = np.concatenate([[True], own[1:] != own[:-1]]) if len(c) else np.zeros(0, dtype=bool)
            place = np.arange(len(c)) - np.maximum.accumulate(np.where(fresh, np.arange(len(c)), 0)) if len(c) else np.zeros(0, dtype=np.int64)
            last = c[place == k - 1]
            low[who[last], j] = score[last]
            c, place = c[place < k], place[place < k]
            at.append(c)
            windows.append(np.full(len(c), j))
            places.append(place)
        return (np.concatenate(at), np.concatenate(windows), np.concatenate(places)), low


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


@dataclass
class Index:
    tree: Tree
    blocks: DataFrame  # leaf, block, x, label, ids, count, bucket
    sizes: dict[int, int]  # blocks of each leaf
    k: int


def build(rows: DataFrame, k: int = 5, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", sample_rows: int = 8192, leaf_rows: int = 1024, max_leaves: int = 1024, block_rows: int = 4096) -> Index | None:
    """Index over all rows: the upper tree from about ``sample_rows`` rows of small id hashes, leaves of about ``leaf_rows`` rows up to ``max_leaves`` of them. None without a usable row."""
    usable_rows = _usable(rows, id_col, label_col, vector_col)
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    total, top = usable_rows.agg(F.count(F.lit(1)), F.max(norm)).first()
    if not total:
        return None
    share = min(1.0, 1.05 * sample_rows / total)
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 32))
    sample = usable_rows.where(h <= int(share * (1 << 32))).select(h.alias("h"), "id", "v").limit(2 * sample_rows).collect()
    sample = sorted(sample, key=lambda r: (r["h"], r["id"], r["v"]))[:sample_rows]
    if not sample:  # a few rows whose hashes all lie above the threshold
        sample = usable_rows.select("id", "v").limit(sample_rows).collect()
    dim = int(pd.Series([len(r["v"]) for r in sample]).mode()[0])
    x = augmented(np.unique(np.array([r["v"] for r in sample if len(r["v"]) == dim], dtype=np.float64), axis=0), top)
    leaves = max(1, min(max_leaves, len(x) // 8, total // leaf_rows))
    tree, _ = grow(x, top, max(1, -(-len(x) // leaves)))
    deep = tree.path.shape[1]

    @F.pandas_udf("struct<leaf:int,d:array<double>>")
    def deal(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vs in batches:
            leaf, d = [], []
            for a in range(0, len(vs), 1024):
                part = augmented(_matrix(vs.iloc[a : a + 1024]), top)
                own = tree.deal(part)
                leaf.append(own)
                d += np.take_along_axis(tree.far(part), tree.path[own], 1).tolist() if deep else [[]] * len(part)
            yield pd.DataFrame({"leaf": np.concatenate(leaf) if leaf else np.zeros(0, dtype=int), "d": pd.Series(d, dtype=object)})

    # one point for the rows of one vector and label, with its k + 1 smallest ids
    w = Window.partitionBy("v", "y").orderBy("id")
    few = usable_rows.where(F.size("v") == dim).distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    points = few.groupBy("v", "y").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    dealt = stored(points.select("ids", "y", "v", deal("v").alias("made")).select("ids", "y", "v", "made.*"))
    ends = [f(F.get("d", F.lit(j))).alias(f"{f.__name__}{j}") for j in range(deep) for f in (F.min, F.max)]
    per_leaf = {r["leaf"]: r for r in dealt.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *ends).collect()}
    for leaf in range(tree.leaves):  # what the sample's rows had is replaced by what all rows have
        r = per_leaf.get(leaf)
        tree.least[leaf] = [r[f"min{j}"] if r else np.inf for j in range(deep)]
        tree.most[leaf] = [r[f"max{j}"] if r else -np.inf for j in range(deep)]
    sizes = {leaf: -(-r["n"] // block_rows) for leaf, r in per_leaf.items()}
    many = dealt.sparkSession.createDataFrame(list(sizes.items()), "leaf int, blocks int")
    salted = dealt.drop("d").join(F.broadcast(many), "leaf").withColumn("block", F.pmod(F.xxhash64("ids", "y"), F.col("blocks")).cast("int"))

    def pack(df: pd.DataFrame) -> pd.DataFrame:
        """One row for a block, its rows in the order of the buckets."""
        x = _matrix(df["v"])
        own, bucket = grow(augmented(x, top), top, BUCKET)
        by = np.lexsort(([i[0] for i in df["ids"]], bucket))
        one = {"leaf": int(df["leaf"].iat[0]), "block": int(df["block"].iat[0]), "x": x[by].tobytes(), "label": [str(y) for y in df["y"].iloc[by]]}
        one |= {"ids": np.concatenate([df["ids"].iat[i] for i in by]).tolist(), "count": [len(df["ids"].iat[i]) for i in by], "bucket": bucket[by].tolist()}
        one |= {"points": own.points.tobytes(), "path": own.path.tobytes(), "least": own.least.tobytes(), "most": own.most.tobytes()}
        return pd.DataFrame([one])

    return Index(tree, stored(salted.groupBy("leaf", "block").applyInPandas(pack, _BLOCK)), sizes, k)


_BLOCK = "leaf int, block int, x binary, label array<string>, ids array<bigint>, count array<int>, bucket array<int>, points binary, path binary, least binary, most binary"


def _usable(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    v, y, i = named(vector_col), named(label_col), named(id_col)
    return rows.where(i.isNotNull() & y.isNotNull() & usable(v)).select(i.cast("long").alias("id"), y.cast("string").alias("y"), F.transform(v, lambda x: x.cast("double")).alias("v"))


def _unpacked(r: pd.Series, top: float) -> Block:
    count, bucket = np.asarray(r["count"]), np.asarray(r["bucket"])
    x = np.frombuffer(r["x"], dtype=np.float64).reshape(len(count), -1)
    ids = [part.tolist() for part in np.split(np.asarray(r["ids"]), np.cumsum(count)[:-1])]
    start = np.concatenate([np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), [len(bucket)]])
    numbers = lambda name, kind: np.frombuffer(r[name], dtype=kind).reshape(len(start) - 1, -1)
    tree = Tree(top, np.frombuffer(r["points"], dtype=np.float64).reshape(-1, x.shape[1] + 1), path=numbers("path", np.int64), least=numbers("least", np.float64), most=numbers("most", np.float64))
    return Block(x, np.asarray(r["label"], dtype=object), np.array([i[0] for i in ids]), ids, start, tree)


_FOUND = "head bigint, asked bigint, score bigint, ids array<bigint>"


def search(index: Index, asked: DataFrame, same: bool, k: int, ahead: int = 2, group_rows: int = 2048) -> DataFrame:
    """head, asked, score, ids: the first ``k`` points of each window of each row of ``asked``, by score, then smallest id.

    asked: head, v, y and windows, an array of struct(asked, low, high), none of them empty; ``same``: points of the row's label, else of other labels.
    """
    spark, tree, filled = asked.sparkSession, index.tree, set(index.sizes)

    @F.pandas_udf("array<int>")
    def reached(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for vs, lows, highs in batches:
            out: list[list[int]] = []
            for a in range(0, len(vs), 256):
                least, most = tree.scores(_matrix(vs.iloc[a : a + 256]))
                for r, (lo, hi) in enumerate(zip(lows.iloc[a : a + 256], highs.iloc[a : a + 256], strict=True)):
                    meets = ((most[r][:, None] >= lo) & (least[r][:, None] <= hi)).any(1)
                    order = np.argsort(-most[r], kind="stable")  # nearest first
                    out.append([int(leaf) for leaf in order[meets[order]] if int(leaf) in filled])
            yield pd.Series(out, dtype=object)

    def visit(probes: DataFrame) -> DataFrame:
        """Candidates of probes (head, v, y, windows, leaves) from the blocks of their leaves, the first k of each window."""
        each = probes.select("head", "v", "y", "windows", F.explode("leaves").alias("leaf"))
        per_leaf = {r["leaf"]: r["count"] for r in each.groupBy("leaf").count().collect()}
        if not per_leaf:
            return spark.createDataFrame([], _FOUND)
        plan = spark.createDataFrame([(leaf, index.sizes[leaf], -(-n // group_rows)) for leaf, n in per_leaf.items()], "leaf int, blocks int, groups int")
        left = index.blocks.join(F.broadcast(plan), "leaf").drop("blocks").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
        right = each.join(F.broadcast(plan), "leaf").withColumn("group", F.pmod(F.xxhash64("head"), F.col("groups")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

        def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            out: dict[str, list] = {"head": [], "asked": [], "score": [], "ids": []}
            if len(a) and len(b):
                block = _unpacked(a.iloc[0], tree.top)
                widest = max(map(len, b["windows"]))
                for s in range(0, len(b), 256):
                    part = b.iloc[s : s + 256]
                    low, high = np.full((len(part), widest), float(_FAR)), np.full((len(part), widest), -float(_FAR))
                    for r, windows in enumerate(part["windows"]):
                        for j, w in enumerate(windows):
                            low[r, j], high[r, j] = w["low"], w["high"]
                    who, window, row, score = block.search(_matrix(part["v"]), part["y"].to_numpy(dtype=object), low, high, same, k)
                    out["head"] += part["head"].to_numpy()[who].tolist()
                    out["asked"] += [part["windows"].iat[r][j]["asked"] for r, j in zip(who, window, strict=True)]
                    out["score"] += score.astype(np.int64).tolist()
                    out["ids"] += [block.ids[r] for r in row]
            return pd.DataFrame({c: pd.Series(v, dtype=object if c == "ids" else "int64") for c, v in out.items()})

        key = ["leaf", "block", "group"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, _FOUND)

    place = Window.partitionBy("head", "asked").orderBy(F.desc("score"), F.get("ids", F.lit(0)))
    first = lambda df: df.withColumn("r", F.row_number().over(place)).where(F.col("r") <= k)
    leaves = lambda: reached("v", F.transform("windows", lambda w: w["low"]), F.transform("windows", lambda w: w["high"]))
    near = cut(asked.withColumn("leaves", F.slice(leaves(), 1, ahead)))
    found = cut(first(visit(near)))
    # what was found closes the windows from below; leaves that still reach into one follow
    closed = found.where(F.col("r") == k).groupBy("head").agg(F.map_from_entries(F.collect_list(F.struct("asked", "score"))).alias("kth"))
    raised = F.transform("windows", lambda w: F.struct(w["asked"].alias("asked"), F.coalesce(F.try_element_at("kth", w["asked"]), w["low"]).alias("low"), w["high"].alias("high")))
    rest = near.withColumnRenamed("leaves", "been").join(closed, "head", "left").withColumn("windows", raised)
    later = visit(cut(rest.withColumn("leaves", F.array_except(leaves(), F.col("been")))))
    return first(found.drop("r").unionByName(later)).drop("r")


def mine(
    rows: DataFrame,
    anchors: DataFrame,
    positives: int = 5,
    k: int = 5,
    low_percent: int = 80,
    high_percent: int = 100,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    **options,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each row of ``anchors`` (rows of the same columns) and each of its ``positives`` nearest other rows of its label, the first ``k`` rows of other labels whose score is between
    ``low_percent`` and ``high_percent`` of the positive's.
    """
    most = max(positives, k)
    index = build(rows, most, id_col, label_col, vector_col, **options)
    if index is None:
        return rows.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    dim = index.tree.points.shape[1] - 1
    given = cut(_usable(anchors, id_col, label_col, vector_col).where(F.size("v") == dim).distinct())
    heads = cut(given.groupBy("v", "y").agg(F.min("id").alias("head")))
    window = lambda asked, low, high: F.struct(asked.cast("long").alias("asked"), low.cast("long").alias("low"), high.cast("long").alias("high"))
    everything = heads.select("head", "v", "y", F.array(window(F.lit(0), F.lit(-_FAR), F.lit(_FAR))).alias("windows"))
    near = cut(search(index, everything, True, most + 1))
    points = near.groupBy("head").agg(F.collect_list(F.struct("score", "ids")).alias("near"))
    own = given.join(heads, ["v", "y"]).select(F.col("id").alias("anchor_id"), "head").join(points, "head")
    own = own.select("anchor_id", "head", F.explode("near").alias("n")).select("anchor_id", "head", F.col("n.score").alias("positive_score"), F.explode("n.ids").alias("positive_id"))
    by_score = Window.partitionBy("anchor_id", "head").orderBy(F.desc("positive_score"), "positive_id")
    own = cut(own.where("anchor_id <> positive_id").withColumn("r", F.row_number().over(by_score)).where(F.col("r") <= positives).drop("r"))

    score = F.col("positive_score")
    # whole-number division downwards, so that no window's end is rounded
    down = lambda x: ((x - F.pmod(x, F.lit(100))) / 100).cast("long")
    low, high = -down(score * -low_percent), down(score * high_percent)
    annuli = own.select("head", score, low.alias("low"), high.alias("high")).where("low <= high").distinct()
    annuli = annuli.groupBy("head").agg(F.collect_list(window(score, F.col("low"), F.col("high"))).alias("windows"))
    found = search(index, heads.join(annuli, "head"), False, k).select("head", "asked", "score", F.explode("ids").alias("negative_id"))
    by_score = Window.partitionBy("head", "asked").orderBy(F.desc("score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    found = found.groupBy("head", F.col("asked").alias("positive_score")).agg(F.collect_list(F.struct("rank", "negative_id", "score")).alias("found"))
    out = own.join(found, ["head", "positive_score"]).select("anchor_id", "positive_id", "positive_score", F.explode("found").alias("f"))
    return out.select("anchor_id", "positive_id", F.col("f.rank").cast("int").alias("rank"), "f.negative_id", "positive_score", F.col("f.score").alias("negative_score"))
