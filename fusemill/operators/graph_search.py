"""The graph query: each question's neighbourhood, best-first paths in it, their grounding in chunks, and chunks ranked by local PageRank.

Entities that a path may go on from are found by joins over the whole edge tables, hop by hop; hubs are no steps. Their edges are one group a question,
bounded by the degree limit and the hops, and are searched in an Arrow batch: the frontier is a priority queue, which no join expresses. Chunks are fetched for what the search has chosen.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusemill.checkpoint import bucketed, written
from fusemill.operators.graph import MAX_APPEARANCES, MAX_DEGREE, TYPE_LABEL


class Step(NamedTuple):
    source: str
    relation: str
    target: str
    reverse: bool = False

    def stored(self) -> tuple[str, str]:
        """The edge as the corpus states it."""
        return (self.target, self.source) if self.reverse else (self.source, self.target)


class Path(NamedTuple):
    start: str
    steps: tuple[Step, ...]


@dataclass
class Settings:
    hops: int = 2
    both_ways: bool = True
    max_paths: int = 500
    max_pops: int = 50_000
    max_entities: int = 256
    chunk_share: float = 0.5
    mode: str = "support"
    alpha: float = 0.85
    rounds: int = 50
    tol: float = 1e-6
    threshold: float = 0.5
    top_k: int = 10


@dataclass
class Local:
    """A piece of the graph: edges[subj, obj][pred] = (support, chunk ids)."""

    edges: dict[tuple[str, str], dict[str, tuple[int, frozenset[str]]]] = field(default_factory=dict)
    chunks: dict[str, set[str]] = field(default_factory=lambda: defaultdict(set))
    specific: dict[str, float] = field(default_factory=dict)
    hubs: set[str] = field(default_factory=set)
    degree: dict[str, int] = field(default_factory=lambda: defaultdict(int))

    def __post_init__(self) -> None:
        self.out: dict[str, list[str]] = defaultdict(list)
        self.into: dict[str, list[str]] = defaultdict(list)
        for a, b in sorted(self.edges):
            self.out[a].append(b)
            self.into[b].append(a)

    def labels(self, a: str, b: str) -> list[str]:
        """Labels of a directed edge that a path may take."""
        found = self.edges.get((a, b), {})
        return sorted(found) if set(found) != {TYPE_LABEL} else []

    def boost(self, a: str, b: str, label: str) -> float:
        found = self.edges.get((a, b))
        return 1.0 if found is None else 1.0 + math.log1p(found[label][0] if label in found else 0)

    def steps(self, node: str, seen: Iterable[str], both_ways: bool) -> Iterable[Step]:
        """Every valid step from ``node``: not to what was seen, not to a hub, not over a type label alone."""
        for reverse, others in ((False, self.out[node]), (True, self.into[node] if both_ways else ())):
            for other in others:
                if other not in seen and other not in self.hubs:
                    for label in self.labels(*((other, node) if reverse else (node, other))):
                        yield Step(node, label, other, reverse)


def best_first(graph: Local, seeds: dict[str, float], s: Settings) -> tuple[list[Path], int]:
    """Paths of one step or more in order of priority, and the number of pops.

    Priority: seed's mass times the least specificity on the path times the last step's support boost. All seeds share one frontier; equal
    priorities go by age, seeds and neighbours in order of name.
    """
    queue: list = []
    spec = lambda n: max(graph.specific.get(n, 0.05), 1e-9)
    for n, (node, mass) in enumerate(sorted(seeds.items())):
        if mass > 0:
            queue.append((-(math.log(max(mass, 1e-12)) + math.log(spec(node))), n, node, Path(node, ()), frozenset((node,)), spec(node), math.log(max(mass, 1e-12))))
    heapq.heapify(queue)
    age, pops, found = len(queue), 0, []
    while queue and len(found) < s.max_paths and pops < s.max_pops:
        _, _, node, path, seen, least, mass = heapq.heappop(queue)
        pops += 1
        if path.steps:
            found.append(path)
        if len(path.steps) >= s.hops:
            continue
        for step in graph.steps(node, seen, s.both_ways):
            low = min(least, spec(step.target))
            rank = mass + math.log(low) + math.log(max(graph.boost(*step.stored(), step.relation), 1e-9))
            heapq.heappush(queue, (-rank, age, step.target, Path(path.start, (*path.steps, step)), seen | {step.target}, low, mass))
            age += 1
    return found, pops


def step_chunks(graph: Local, step: Step) -> set[str] | None:
    """Chunks that may ground a step: the edge's own, else those of both ends, else those of either; None without the edge."""
    found = graph.edges.get(step.stored())
    if found is None:
        return None
    own = set(found[step.relation][1]) if step.relation in found else set()
    if own:
        return own
    a, b = graph.chunks[step.source], graph.chunks[step.target]
    return a & b or a | b


def step_support(graph: Local, step: Step, chunk: str) -> float:
    found = graph.edges.get(step.stored(), {})
    return float(step.relation in found and chunk in found[step.relation][1])


@dataclass
class Grounded:
    path: Path
    chunk_ids: list[str]
    failure: str | None = None  # missing_rel_edge or weak_hop_support
    at: int | None = None
    support: float | None = None


def ground(graph: Local, path: Path, threshold: float = 0.5) -> Grounded:
    """Each step's best supported chunk (the first by id), or where and why that failed."""
    ids: list[str] = []
    for k, step in enumerate(path.steps):
        among = step_chunks(graph, step)
        if among is None:
            return Grounded(path, [], "missing_rel_edge", k)
        best = max(sorted(among), key=lambda c: step_support(graph, step, c), default=None)
        score = step_support(graph, step, best) if best is not None else 0.0
        if score < threshold:
            return Grounded(path, [], "weak_hop_support", k, score)
        ids.append(best)
    return Grounded(path, ids)


def scope(graph: Local, paths: list[Path], seeds: Iterable[str], most: int) -> list[str]:
    """Entities of the seeds and paths; beyond ``most``, seeds first, then greater relational degree, then name."""
    seeds = set(seeds)
    all_ = seeds | {p.start for p in paths} | {n for p in paths for s in p.steps for n in (s.source, s.target)}
    if len(all_) > most:
        all_ = set(sorted(all_, key=lambda e: (e not in seeds, -graph.degree[e], e))[:most])
    return sorted(all_)


class Moves(NamedTuple):
    """A row-stochastic matrix by its filled places."""

    src: np.ndarray
    dst: np.ndarray
    p: np.ndarray
    size: int

    def step(self, mass: np.ndarray) -> np.ndarray:
        return np.bincount(self.dst, weights=mass[self.src] * self.p, minlength=self.size)


def local_moves(graph: Local, entities: list[str], s: Settings) -> tuple[Moves, list[str]]:
    """Moves over the entities and the chunks next to them."""
    chunks = sorted({c for e in entities for c in graph.chunks[e]})
    at = {e: k for k, e in enumerate(entities)}
    place = {c: len(entities) + k for k, c in enumerate(chunks)}
    rows: list[tuple[int, int, float]] = []
    back: dict[int, list[int]] = defaultdict(list)
    for e in entities:
        weight: dict[int, float] = {}
        for a, b in [(e, o) for o in graph.out[e]] + [(o, e) for o in graph.into[e]]:
            other = at.get(b if a == e else a)
            if other is not None:
                w = max((graph.boost(a, b, x) for x in graph.labels(a, b)), default=0.0) if s.mode == "support" else 1.0
                weight[other] = max(weight.get(other, 0.0), w)
        if weight and sum(weight.values()) <= 0:
            weight = dict.fromkeys(weight, 1.0)
        near = sorted(place[c] for c in graph.chunks[e])
        share, total = s.chunk_share if weight else 1.0, sum(weight.values())
        rows += [(at[e], j, (1 - share if near else 1.0) * w / total) for j, w in weight.items()]
        rows += [(at[e], j, share / len(near)) for j in near]
        for j in near:
            back[j].append(at[e])
        if not weight and not near:
            rows.append((at[e], at[e], 1.0))
    rows += [(j, k, 1 / len(owners)) for j, owners in back.items() for k in owners]
    src, dst, p = zip(*rows, strict=True) if rows else ((), (), ())
    return Moves(np.array(src, dtype=int), np.array(dst, dtype=int), np.array(p, dtype=float), len(at) + len(place)), chunks


def walk(moves: Moves, restart: np.ndarray, alpha: float, rounds: int, tol: float) -> tuple[np.ndarray, int, float]:
    """Masses, rounds and last residual; the round that moves less than ``tol`` isn't taken."""
    start = np.maximum(restart, 0.0)
    start = start / start.sum() if start.sum() > 0 else np.full(len(start), 1 / max(1, len(start)))
    mass, gap, k = start.copy(), 0.0, 0
    for k in range(1, rounds + 1):
        new = alpha * moves.step(mass) + (1 - alpha) * start
        gap = float(np.abs(new - mass).sum())
        if gap < tol:
            break
        mass = new
    return mass, k, gap


def spelled(path: Path) -> str:
    """a -[label]-> b, reverse steps as inv:label."""
    if not path.steps:
        return path.start
    return path.steps[0].source + "".join(f" -[{'inv:' * s.reverse}{s.relation}]-> {s.target}" for s in path.steps)


def bundle_score(graph: Local, path: Path, mass: dict[str, float]) -> float:
    """Greatest mass of the path's ends times half plus half their mean specificity."""
    ends = [n for s in path.steps for n in (s.source, s.target)]
    if not ends:
        return 0.0
    return max(mass.get(n, 0.0) for n in ends) * (0.5 + 0.5 * float(np.mean([graph.specific.get(n, 0.05) for n in ends])))


def concluded(graph: Local, seeds: dict[str, float], paths: list[Path], pops: int, entities: list[str], s: Settings) -> tuple[list[tuple[str, float, list[str]]], dict[str, float]]:
    """Ranked (chunk, mass, path lines) by the paths found and the entities in scope, and the figures of the search."""
    reports = [ground(graph, p, s.threshold) for p in paths]
    m, chunks = local_moves(graph, entities, s)
    mass, rounds, gap = walk(m, np.array([seeds.get(e, 0.0) for e in entities] + [0.0] * len(chunks)), s.alpha, s.rounds, s.tol)
    of = dict(zip(entities, mass[: len(entities)].tolist(), strict=True))
    by_chunk = defaultdict(list)
    for r in reports:
        for c in set(r.chunk_ids):
            by_chunk[c].append((-bundle_score(graph, r.path, of), r.path.steps, sorted(set(r.chunk_ids)), r.path))
    ranked = sorted(zip(chunks, mass[len(entities) :].tolist(), strict=True), key=lambda x: (-x[1], x[0]))[: s.top_k]
    figures = {"pops": pops, "paths": len(paths), "grounded": sum(bool(r.chunk_ids) for r in reports), "entities": len(entities), "rounds": rounds, "residual": gap}
    return [(c, w, ["Path: " + spelled(x[-1]) for x in sorted(by_chunk[c], key=lambda x: x[:3])[:3]]) for c, w in ranked], figures


def answer(graph: Local, seeds: dict[str, float], s: Settings) -> tuple[list[tuple[str, float, list[str]]], dict[str, float]]:
    """Ranked (chunk, mass, path lines) of one question, and its figures."""
    paths, pops = best_first(graph, seeds, s)
    return concluded(graph, seeds, paths, pops, scope(graph, paths, seeds, s.max_entities), s)


_ASKED = "question_id string, kind string, a string, b string, found binary"
_FOUND = "question_id string, chunk_id string, score double, rank int, path_lines array<string>, pops int, paths int, grounded int, entities int, rounds int, residual double"


def _edges_ahead(seeds: DataFrame, rel: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges by each of their ends, in buckets: entity, other, reverse, pred, support, and specificity, rel_degree and hub of the other. Edges to hubs stay only if these are seeds."""
    asked = seeds.select("entity").distinct().withColumn("asked", F.lit(True))
    ends = nodes.join(asked, "entity", "left").where(~F.col("hub") | F.col("asked")).select(F.col("entity").alias("other"), "specificity", "rel_degree", "hub")
    one = lambda a, b, reverse: rel.select(F.col(a).alias("entity"), F.col(b).alias("other"), F.lit(reverse).alias("reverse"), "pred", "support")
    return bucketed(one("subj", "obj", False).union(one("obj", "subj", True)).join(ends, "other"), "ahead", "entity")


def _searched(seeds: DataFrame, ahead: DataFrame, s: Settings) -> DataFrame:
    """Each question's search by the edges of those entities alone that a path may go on from, and what it asks for then. seeds: question_id, entity, mass, specificity, rel_degree, hub.

    Rows: found (the search, pickled), scope (an entity whose edges and chunks are asked for), near (one whose chunks are), edge (an edge of a path).
    """
    ways = (ahead if s.both_ways else ahead.where("NOT reverse")).where("NOT hub")
    frontier = scope_ = seeds.select("question_id", "entity").distinct()
    for _ in range(s.hops - 1):
        frontier = frontier.join(ways, "entity").select("question_id", F.col("other").alias("entity")).distinct()
        scope_ = written(scope_.union(frontier).distinct(), "frontier")
    none = F.lit(None)
    starts = seeds.select("question_id", "entity", none.cast("string").alias("other"), none.cast("boolean").alias("reverse"), none.cast("string").alias("pred"), none.cast("bigint").alias("support"), "specificity", "rel_degree", "hub", "mass")
    steps = scope_.where(F.lit(s.hops > 0)).join(ways, "entity").select("question_id", "entity", "other", "reverse", "pred", "support", "specificity", "rel_degree", "hub", none.cast("double").alias("mass"))

    def search(group: pd.DataFrame) -> pd.DataFrame:
        edges: dict[tuple[str, str], dict[str, tuple[int, frozenset[str]]]] = {}
        specific, hubs, masses, degree = {}, set(), {}, defaultdict(int)
        for r in group.itertuples():
            name = r.entity if r.other is None else r.other
            specific[name], degree[name] = r.specificity, int(r.rel_degree)
            if r.other is None:
                masses[name] = r.mass
                if r.hub:
                    hubs.add(name)
            else:
                edges.setdefault((r.other, r.entity) if r.reverse else (r.entity, r.other), {})[r.pred] = (int(r.support), frozenset())
        graph = Local(edges, specific=specific, hubs=hubs, degree=degree)
        paths, pops = best_first(graph, masses, s)
        entities = scope(graph, paths, masses, s.max_entities)
        ends = sorted({n for p in paths for x in p.steps for n in (x.source, x.target)})
        found = pickle.dumps(([tuple(map(tuple, p.steps)) for p in paths], pops, entities, masses, {n: specific[n] for n in {*ends, *masses} if n in specific}))
        rows = [("found", None, None, found)] + [("scope", e, None, None) for e in entities] + [("edge", *e, None) for e in sorted({x.stored() for p in paths for x in p.steps})]
        if s.threshold <= 0:  # only then may a chunk of its ends ground a step
            rows += [("near", e, None, None) for e in ends if e not in set(entities)]
        return pd.DataFrame([(group["question_id"].iat[0], *r) for r in rows], columns=[c.split()[0] for c in _ASKED.split(", ")])

    return written(starts.unionByName(steps).groupBy("question_id").applyInPandas(search, _ASKED), "searched")


def retrieve(seeds: DataFrame, appears: DataFrame, rel: DataFrame, degree: DataFrame, settings: Settings | None = None) -> DataFrame:
    """question_id, chunk_id, score, rank (from 0), path_lines, and the figures of the question's search. seeds: question_id, entity, mass; appears: entity, chunk_id;
    rel: subj, pred, obj, support, chunk_ids; degree: entity, appearances, rel_degree, total_degree, specificity. Ids are strings.

    The search comes first and takes edges only; chunks, and the edges' chunk ids, are fetched for the entities and edges that it has chosen, not for the whole neighbourhood.
    Questions without a seed in the graph give no rows, which is their NO_CONTEXT.
    """
    s = settings or Settings()
    hub = (F.col("total_degree") > MAX_DEGREE) | (F.col("appearances") > MAX_APPEARANCES)
    nodes = written(degree.select("entity", "specificity", "rel_degree", hub.alias("hub")), "nodes")
    rel = written(rel.select("subj", "pred", "obj", "support", "chunk_ids"), "rel")
    known = written(seeds.select("question_id", "entity", "mass").where(F.col("mass") > 0).join(nodes, "entity"), "seeds")
    ahead = _edges_ahead(known, rel, nodes)
    asked = _searched(known, ahead, s)
    none, text, listed = F.lit(None), F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    row = lambda df, kind, a=text, b=text, pred=text, support=none.cast("bigint"), ids=listed, found=none.cast("binary"): df.select(
        "question_id", F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), pred.alias("pred"), support.alias("support"), ids.alias("ids"), found.alias("found")
    )
    inside = asked.where("kind = 'scope'").select("question_id", F.col("a").alias("entity"))
    wanted = asked.where("kind IN ('scope', 'near')").select("question_id", F.col("a").alias("entity"))
    of = appears.join(wanted.select("entity").distinct(), "entity", "left_semi").groupBy("entity").agg(F.collect_set("chunk_id").alias("ids"))
    taken = asked.where("kind = 'edge'").select("question_id", F.col("a").alias("subj"), F.col("b").alias("obj")).join(rel, ["subj", "obj"])
    parts = [
        row(asked.where("kind = 'found'"), "found", found=F.col("found")),
        row(inside.join(ahead.where("NOT reverse"), "entity"), "edge", F.col("entity"), F.col("other"), F.col("pred"), F.col("support")),
        row(taken, "taken", F.col("subj"), F.col("obj"), F.col("pred"), F.col("support"), F.col("chunk_ids")),
        row(wanted.join(of, "entity"), "chunks", F.col("entity"), ids=F.col("ids")),
    ]

    def rank(group: pd.DataFrame) -> pd.DataFrame:
        steps, pops, entities, masses, specific = pickle.loads(next(iter(group.loc[group["kind"] == "found", "found"])))
        paths = [Path(p[0][0], tuple(Step(*x) for x in p)) for p in steps]
        within, chunks = set(entities), defaultdict(set)
        edges: dict[tuple[str, str], dict[str, tuple[int, frozenset[str]]]] = {}
        for r in group.itertuples():
            if r.kind == "chunks":
                chunks[r.a] = set(r.ids)
            elif r.kind == "edge" and r.b in within:
                edges.setdefault((r.a, r.b), {}).setdefault(r.pred, (int(r.support), frozenset()))
            elif r.kind == "taken":
                edges.setdefault((r.a, r.b), {})[r.pred] = (int(r.support), frozenset(r.ids))
        ranked, figures = concluded(Local(edges, chunks, specific), masses, paths, pops, entities, s)
        qid = group["question_id"].iat[0]
        return pd.DataFrame([(qid, c, w, k, lines, *figures.values()) for k, (c, w, lines) in enumerate(ranked)], columns=[x.split()[0] for x in _FOUND.split(", ")])

    return reduce(DataFrame.unionByName, parts).groupBy("question_id").applyInPandas(rank, _FOUND)
