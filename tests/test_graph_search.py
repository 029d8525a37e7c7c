"""The graph query in small graphs: steps, paths, grounding, masses, and the whole against a plain search over the same tables."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fusemill import checkpoint
from fusemill.operators import graph, graph_search
from fusemill.operators.graph_search import Local, Path, Settings, Step

TOY = {("a", "b"): {"causes": (1, frozenset({"c1"}))}, ("b", "c"): {"causes": (1, frozenset({"c2"}))}}


def toy(edges=TOY, chunks=None, **more):
    where = chunks if chunks is not None else {"a": {"c1"}, "b": {"c1", "c2"}, "c": {"c2"}}
    return Local(edges, defaultdict(set, where), more.pop("specific", dict.fromkeys("abc", 0.5)), **more)


def test_best_first_paths():
    paths, pops = graph_search.best_first(toy(), {"a": 1.0}, Settings())
    assert [graph_search.spelled(p) for p in paths] == ["a -[causes]-> b", "a -[causes]-> b -[causes]-> c"] and pops == 3
    back, _ = graph_search.best_first(toy(), {"c": 1.0}, Settings())
    assert [graph_search.spelled(p) for p in back] == ["c -[inv:causes]-> b", "c -[inv:causes]-> b -[inv:causes]-> a"]
    assert graph_search.best_first(toy(), {"c": 1.0}, Settings(both_ways=False))[0] == []
    assert graph_search.best_first(toy(hubs={"b"}), {"a": 1.0}, Settings())[0] == []
    assert len(graph_search.best_first(toy(), {"a": 1.0}, Settings(max_paths=1))[0]) == 1
    assert graph_search.best_first(toy(), {"a": 0.0}, Settings()) == ([], 0)
    typed = toy({("a", "b"): {"instance_of": (1, frozenset({"c1"}))}, ("a", "c"): {"instance_of": (1, frozenset()), "led": (1, frozenset())}})
    assert {p.steps[0].target for p in graph_search.best_first(typed, {"a": 1.0}, Settings(hops=1))[0]} == {"c"}
    # the heavier seed, the more specific target and the better supported edge come first
    wide = toy({("s", "x"): {"r": (1, frozenset())}, ("s", "y"): {"r": (9, frozenset())}, ("t", "z"): {"r": (9, frozenset())}}, {}, specific={"s": 1, "t": 1, "x": 0.4, "y": 0.4, "z": 0.4})
    assert [p.steps[0].target for p in graph_search.best_first(wide, {"s": 0.9, "t": 0.1}, Settings())[0]] == ["y", "x", "z"]


def test_grounding():
    path = graph_search.best_first(toy(), {"a": 1.0}, Settings())[0][1]
    assert graph_search.ground(toy(), path).chunk_ids == ["c1", "c2"]
    bare = toy({("a", "b"): {"causes": (1, frozenset())}})
    step = Step("a", "causes", "b")
    assert graph_search.step_chunks(bare, step) == {"c1"} and graph_search.step_support(bare, step, "c1") == 0.0
    weak = graph_search.ground(bare, Path("a", (step,)))
    assert (weak.failure, weak.at, weak.support, weak.chunk_ids) == ("weak_hop_support", 0, 0.0, [])
    gone = graph_search.ground(toy(), Path("a", (Step("a", "causes", "c"),)))
    assert (gone.failure, gone.at) == ("missing_rel_edge", 0) and graph_search.step_chunks(toy(), Step("a", "x", "c")) is None
    assert Step("a", "r", "b", True).stored() == ("b", "a")
    apart = toy({("a", "c"): {"r": (1, frozenset())}})
    assert graph_search.step_chunks(apart, Step("a", "r", "c")) == {"c1", "c2"}


def dense(moves):
    m = np.zeros((moves.size, moves.size))
    np.add.at(m, (moves.src, moves.dst), moves.p)
    return m


def sparse(m):
    src, dst = np.nonzero(m)
    return graph_search.Moves(src, dst, m[src, dst], len(m))


def test_local_moves_and_walk():
    moves, chunks = graph_search.local_moves(toy(), ["a", "b", "c"], Settings())
    m = dense(moves)
    assert chunks == ["c1", "c2"] and np.allclose(m.sum(1), 1)
    assert np.allclose(m[0], [0, 0.5, 0, 0.5, 0]) and np.allclose(m[1], [0.25, 0, 0.25, 0.25, 0.25]) and np.allclose(m[3], [0.5, 0.5, 0, 0, 0])
    lone, _ = graph_search.local_moves(toy({}, {}), ["z"], Settings())
    assert dense(lone).tolist() == [[1.0]]
    typed, _ = graph_search.local_moves(toy({("a", "b"): {"instance_of": (3, frozenset())}}, {}), ["a", "b"], Settings())
    assert dense(typed).tolist() == [[0, 1], [1, 0]]  # nothing has weight: uniform
    start = np.array([1.0, 0, 0, 0, 0])
    mass, rounds, gap = graph_search.walk(moves, start, 0.85, 200, 1e-9)
    assert math.isclose(mass.sum(), 1) and gap < 1e-9 and rounds < 200
    exact = np.linalg.solve(np.eye(5) - 0.85 * m.T, 0.15 * start)
    assert np.allclose(mass, exact, atol=1e-7)
    once, n, _ = graph_search.walk(moves, start, 0.85, 1, 10.0)
    assert n == 1 and once.tolist() == start.tolist()  # the round that moves less than tol isn't taken
    assert graph_search.scope(toy(degree=defaultdict(int, a=1, b=2, c=1)), [Path("a", (Step("a", "causes", "b"), Step("b", "causes", "c")))], {"c"}, 2) == ["b", "c"]


def tables(spark, triples, chunks):
    names = "subj string, pred string, obj string, chunk_id string"
    appears = graph.appears_in(spark.createDataFrame(chunks, "chunk_id string, entities array<string>"))
    rel = graph.rel_edges(spark.createDataFrame(triples, names), with_chunks=True)
    degree = graph.degrees(appears, rel).withColumn("specificity", graph.specificity(F.col("appearances"), F.col("rel_degree"), F.col("total_degree"), F.lit(1.0)))
    return appears, rel, degree


def test_retrieve(spark):
    appears, rel, degree = tables(spark, [("a", "causes", "b", "c1"), ("b", "causes", "c", "c2")], [("c1", ["a", "b"]), ("c2", ["b", "c"]), ("c9", ["z"])])
    seeds = spark.createDataFrame([("q1", "a", 1.0), ("q2", "nowhere", 1.0), ("q3", "z", 1.0)], "question_id string, entity string, mass double")
    out = defaultdict(list)
    for r in graph_search.retrieve(seeds, appears, rel, degree).collect():
        out[r.question_id].append(r)
    assert set(out) == {"q1", "q3"}
    first = sorted(out["q1"], key=lambda r: r["rank"])
    assert [r.chunk_id for r in first] == ["c1", "c2"] and first[0].path_lines[0].startswith("Path: a -[causes]-> b") and first[0].paths == 2
    assert [r.chunk_id for r in out["q3"]] == ["c9"] and out["q3"][0].paths == 0
    spec = {r.entity: r.specificity for r in degree.collect()}
    g = Local(TOY, defaultdict(set, {"a": {"c1"}, "b": {"c1", "c2"}, "c": {"c2"}}), spec)
    want, _ = graph_search.answer(g, {"a": 1.0}, Settings())
    assert [(r.chunk_id, round(r.score, 9)) for r in first] == [(c, round(s, 9)) for c, s, _ in want]


def test_comparison_question_reaches_both_chains(spark):
    triples = [("film one", "directed_by", "ann", "c1"), ("film two", "directed_by", "bob", "c1")]
    appears, rel, degree = tables(spark, triples, [("c1", ["film one", "film two", "ann", "bob"])])
    seeds = spark.createDataFrame([("q", "film one", 0.5), ("q", "film two", 0.5)], "question_id string, entity string, mass double")
    (row,) = graph_search.retrieve(seeds, appears, rel, degree).collect()
    assert row.chunk_id == "c1" and {"ann", "bob"} <= {x.rsplit("-> ", 1)[1] for x in row.path_lines}


def test_transitions_and_tolerance(spark):
    appears, rel, _ = tables(spark, [("a", "links", "b", "c1")], [("c1", ["a", "b"])])
    rows = {(r.src, r.dst): r.p for r in graph.settled(graph.transitions(appears, rel, 0.5, "uniform"), spark.createDataFrame([("E:lone",), ("E:a",)], "node string")).collect()}
    assert rows == {("E:a", "E:b"): 0.5, ("E:a", "C:c1"): 0.5, ("E:b", "E:a"): 0.5, ("E:b", "C:c1"): 0.5, ("C:c1", "E:a"): 0.5, ("C:c1", "E:b"): 0.5, ("E:lone", "E:lone"): 1.0}
    moves = graph.transitions(appears, rel)
    restart = graph.restart_row(spark.createDataFrame([("E:a",), ("E:b",), ("C:c1",)], "node string"), spark.createDataFrame([("E:a", 2.0), ("E:x", 1.0), ("E:b", -1.0)], "node string, mass double"))
    assert {r.node: r.mass for r in restart.collect()} == {"E:a": 1.0, "E:b": 0.0, "C:c1": 0.0}
    got = {r.node: r.mass for r in graph.pagerank(moves, restart, rounds=60, tol=1e-6).collect()}
    m = np.array([[0, 0.5, 0.5], [0.5, 0, 0.5], [0.5, 0.5, 0]])
    want, _, _ = graph_search.walk(sparse(m), np.array([1.0, 0, 0]), 0.85, 60, 1e-6)
    assert np.allclose([got["E:a"], got["E:b"], got["C:c1"]], want, atol=1e-12)
    assert {r.mass for r in graph.restart_row(spark.createDataFrame([("x",), ("y",)], "node string"), restart).collect()} == {0.5}
    typed = spark.createDataFrame([("a", "instance_of", "b", 3), ("a", "led", "c", 1)], "subj string, pred string, obj string, support int")
    assert {(r.a, r.b): round(r.w, 6) for r in graph.related(typed).collect()}[("a", "b")] == 0.0


def test_restart_distribution(spark):
    make = lambda rows, tau: {r.node: r.mass for r in graph.restart_distribution(spark.createDataFrame(rows, "question_id string, node string, df int, phi double"), tau).collect()}
    got = make([("q", "rare", 1, 1.0), ("q", "freq", 500, 0.0)], 1.0)
    assert math.isclose(sum(got.values()), 1) and got["rare"] > got["freq"]
    low = make([("q", "first", 5, 1.0), ("q", "second", 5, 0.99)], 1e-6)
    assert low["first"] > 0.99
    want = {"rare": 1 * math.log(502 / 2), "freq": math.exp(-1) * math.log(502 / 501)}
    assert all(math.isclose(got[k], want[k] / sum(want.values())) for k in got)


def test_seed_signals(spark):
    df = spark.createDataFrame([("n", ["n"], 0.9), ("m", ["n"], 0.1), ("o", ["n"], 0.0)], "norm string, extracted array<string>, best double")
    got = {r.norm: r.c for r in df.select("norm", graph.coverage(F.col("norm"), F.col("extracted"), F.col("best")).alias("c")).collect()}
    assert got == {"n": 1.0, "m": 0.25, "o": 0.5}
    s = spark.createDataFrame([("q", f"n{k}", k / 10) for k in range(1, 7)], "q string, node string, specificity double")
    (row,) = graph.seed_summary(s, "q").collect()
    assert (row.least, row.median, row.greatest) == (0.1, 0.4, 0.6) and [x.node for x in row.lowest] == ["n1", "n2", "n3", "n4", "n5"]


def test_walk_over_edges_equals_pagerank_over_moves(spark):
    rng = random.Random(5)
    lines = [(f"c{rng.randrange(12)}", rng.randrange(1, 6), rng.choice("abcdefgh")) for _ in range(70)] + [("c0", 1, None), ("alone", 1, "z"), ("twin", 1, "y"), ("twin", 2, "y")]
    frame = spark.createDataFrame(lines, "chunk_id string, line int, entity string")
    triples = graph.next_in_chunk(frame).withColumn("pred", F.lit("next_to"))
    want = sorted((a[2] or "", b[2] or "", a[0]) for a in lines for b in lines if a[0] == b[0] and b[1] == a[1] + 1)
    assert sorted((r.subj or "", r.obj or "", r.chunk_id) for r in triples.collect()) == want
    whole = frame.where("entity IS NOT NULL")
    triples = graph.next_in_chunk(whole).withColumn("pred", F.lit("next_to"))
    mixed = triples.unionByName(spark.createDataFrame([("a", "b", "x", "instance_of"), ("q", "r", "x", "instance_of"), (None, "a", "x", "next_to"), ("a", None, "x", "next_to")], "subj string, obj string, chunk_id string, pred string"))
    for t, mode in ((triples, "support"), (mixed, "support"), (mixed, "uniform")):
        made, plain = graph.related_of(t, mode), graph.related(graph.rel_edges(t), mode)
        assert sorted(made.collect(), key=repr) == sorted(plain.collect(), key=repr)
    appears, rel = whole.select("entity", "chunk_id").distinct(), graph.rel_edges(mixed.where("subj IS NOT NULL AND obj IS NOT NULL"))
    seeds = spark.createDataFrame([("a", 0.5), ("q", 0.25), ("z", 0.25)], "entity string, mass double")
    for rounds in (1, 4):
        entities, chunks = graph.walked(appears, graph.related(rel), seeds, rounds=rounds)
        got = {f"E:{r.entity}": r.mass for r in entities.collect()} | {f"C:{r.chunk_id}": r.mass for r in chunks.collect()}
        plain = graph.pagerank(graph.transitions(appears, rel), seeds.select(F.concat(F.lit("E:"), "entity").alias("node"), "mass"), rounds=rounds)
        assert got == pytest.approx({r.node: r.mass for r in plain.collect()})


def test_walk_moves_no_edges(spark, tmp_path):
    """Of a join by an edge's start only the masses are moved: the edges are read in their buckets."""
    frame = spark.range(4000).selectExpr("CAST(id % 500 AS long) chunk_id", "CAST(id DIV 500 AS int) line", "CAST(id * 7 % 301 AS long) entity")
    near = graph.related_of(graph.next_in_chunk(frame).withColumn("pred", F.lit("next_to")))
    table = checkpoint.bucketed(near, "near", "a")
    joined = table.hint("merge").join(frame.select(F.col("entity").alias("a")).distinct(), "a")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(a#") == 1 and "SelectedBucketsCount" in plan


@pytest.mark.parametrize("settings", [Settings(), Settings(max_paths=7, max_entities=6), Settings(both_ways=False, hops=3), Settings(threshold=0.0, max_paths=9, max_entities=5)], ids=["whole", "few", "one way", "loose"])
def test_retrieve_equals_a_plain_search_of_the_whole_graph(spark, settings):
    rng = random.Random(8)
    names = [f"e{k:02d}" for k in range(30)]
    triples = [(a, rng.choice(["led", "met", "instance_of"]), b, f"c{rng.randrange(40):02d}") for a, b in (rng.sample(names, 2) for _ in range(110))]
    chunks = [(f"c{k:02d}", rng.sample(names, 3)) for k in range(40)] + [(f"h{k}", ["e00", "e01"]) for k in range(31)]  # e00 and e01 are hubs
    triples += [("e00", "led", "e01", "c01"), ("e02", "led", "e00", "c02"), ("e02", "gone", "e03", None)]
    appears, rel, degree = tables(spark, triples, chunks)
    asked = [("p", "e00", 0.5), ("p", "e01", 0.3), ("p", "e02", 0.2), ("q", "e05", 1.0), ("q", "e06", 0.0)]
    got = graph_search.retrieve(spark.createDataFrame(asked, "question_id string, entity string, mass double"), appears, rel, degree, settings).collect()
    edges, of = {}, defaultdict(set)
    for r in rel.collect():
        edges.setdefault((r.subj, r.obj), {})[r.pred] = (r.support, frozenset(r.chunk_ids))
    for r in appears.collect():
        of[r.entity].add(r.chunk_id)
    d = degree.collect()
    hubs = {r.entity for r in d if r.total_degree > graph.MAX_DEGREE or r.appearances > graph.MAX_APPEARANCES}
    assert {"e00", "e01"} <= hubs
    whole = Local(edges, of, {r.entity: r.specificity for r in d}, hubs, defaultdict(int, {r.entity: r.rel_degree for r in d}))
    for q in "pq":
        want, figures = graph_search.answer(whole, {e: m for i, e, m in asked if i == q and m > 0}, settings)
        rows = sorted((r for r in got if r.question_id == q), key=lambda r: r["rank"])
        assert [(r.chunk_id, r.path_lines) for r in rows] == [(c, lines) for c, _, lines in want] and [r.score for r in rows] == pytest.approx([w for _, w, _ in want])
        assert {k: rows[0][k] for k in figures} == pytest.approx(figures)


def test_retrieve_fetches_chunks_of_its_scope_only(spark, monkeypatch):
    triples = [("s", "met", f"n{k:03d}", "c") for k in range(100)] + [(f"n{k:03d}", "met", f"m{k:03d}", "c") for k in range(100)]
    appears, rel, degree = tables(spark, triples, [(f"c{k}", [f"n{k:03d}", f"m{k:03d}"]) for k in range(100)] + [("c", ["s"])])
    seeds, seen = spark.createDataFrame([("q", "s", 1.0)], "question_id string, entity string, mass double"), []
    monkeypatch.setattr(graph_search, "written", lambda df, name: seen.append((name, out := checkpoint.written(df, name))) or out)
    graph_search.retrieve(seeds, appears, rel, degree, Settings(max_paths=5)).collect()
    asked = [r for name, df in seen if name == "searched" for r in df.collect()]
    assert sum(r.kind in ("scope", "near") for r in asked) == 6 and sum(r.kind == "edge" for r in asked) == 5
