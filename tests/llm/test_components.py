"""Components by contraction: rounds, and labels against union-find."""

import random

from fusemill.llm import simhash


def test_an_ordered_chain_takes_one_round(spark, monkeypatch):
    """Labels, links and the rest after each round are written, and so is every second lookup: few tables whatever the order of the nodes."""
    written = []
    keep = simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df: written.append(1) or keep(df))
    n = 60
    labels = simhash.components(spark.createDataFrame([(k, k + 1) for k in range(n)], "src long, dst long"))
    assert {r.node: r.label for r in labels.collect()} == dict.fromkeys(range(n + 1), 0)
    assert len(written) <= 9


def test_labels_are_those_of_union_find(spark):
    rng = random.Random(3)
    nodes = rng.sample(range(-(1 << 40), 1 << 40), 160)
    edges = [(a, b) for a, b in ((rng.choice(nodes), rng.choice(nodes)) for _ in range(90)) if a < b] + list(zip(sorted(nodes)[:40:2], sorted(nodes)[2:42:2], strict=True))
    low = {x: x for e in edges for x in e}
    for _ in low:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    labels = simhash.components(spark.createDataFrame(edges, "src long, dst long"))
    assert {r.node: r.label for r in labels.collect()} == low
