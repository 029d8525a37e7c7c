"""Credit and ranking metrics against worked examples."""

import math

from pyspark.sql import functions as F

from fusemill.operators import ranking

PARIS = ["The capital of France is Paris.", "Paris is the capital of France.", "Totally unrelated content."]
GREEK = ["Alpha fact here.", "Alpha fact again.", "Beta fact goes.", "Gamma fact ends."]


def rels(spark, chunks, golds, source):
    df = spark.createDataFrame([("q", k, t, golds, source) for k, t in enumerate(chunks)], "question_id string, rank int, text string, golds array<string>, source string")
    df = df.withColumn("golds", ranking.distinct_golds(F.col("golds")))
    met = df.withColumns({"contained": ranking.contained_golds(F.col("text"), F.col("golds")), "any_of": ranking.any_gold(F.col("source"))})
    return [r.rel for r in sorted(ranking.credit(met).collect(), key=lambda r: r["rank"])]


def test_credit(spark):
    assert rels(spark, PARIS, [PARIS[0]], "nq") == [1, 0, 0]
    assert rels(spark, GREEK, [GREEK[0], GREEK[2], GREEK[3]], "2wiki") == [1, 0, 1, 1]
    assert rels(spark, ["alpha", "alpha", "beta"], ["alpha", "beta"], "unheard of") == [1, 0, 1]
    assert rels(spark, ["x alpha beta", "alpha"], ["alpha", "beta", "ALPHA"], None) == [1, 0]  # one credit a chunk, the first gold not credited yet
    assert rels(spark, ["alpha beta", "alpha beta"], ["alpha", "beta"], "hotpotqa") == [1, 1]
    assert rels(spark, ["alpha", "beta alpha"], [], "nq") == [0, 0]
    gold = "computer- supported cooperative work ( CSCW)."
    assert rels(spark, ["On computer-supported cooperative work (CSCW)."], [gold], "nq") == [1]


def test_score_lists(spark):
    chunks = [("a", k, t) for k, t in enumerate(["x a fact", "x b fact", "other"])] + [("n", 0, "noise"), ("n", 1, "x fact"), ("e", 0, "x fact")]
    golds = [("a", "2wiki", ["a fact", "b fact", "c fact"], "OK"), ("n", "nq", ["x fact"], "OK"), ("e", "nq", ["x fact"], "ERROR"), ("z", "nq", ["x"], "NO_CONTEXT")]
    out = ranking.score_lists(spark.createDataFrame(chunks, "question_id string, rank int, text string"), spark.createDataFrame(golds, "question_id string, dataset_source string, golds array<string>, status string"), (1, 2, 3, 5))
    got = {r.question_id: r for r in out.collect()}
    assert math.isclose(got["a"].recall_3, 2 / 3, abs_tol=1e-6)
    best = 1 + 1 / math.log2(3) + 0.5
    assert math.isclose(got["a"].ndcg_3, (1 + 1 / math.log2(3)) / best, abs_tol=1e-6) and got["a"].ndcg_1 == 1.0
    assert (got["n"].hit_1, got["n"].hit_2) == (0.0, 1.0) and math.isclose(got["n"].ndcg_5, 1 / math.log2(3), abs_tol=1e-6)
    assert got["e"].ndcg_5 == got["z"].ndcg_5 == got["z"].hit_1 == 0.0
