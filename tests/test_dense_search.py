"""Vector search in blocks against one pair at a time."""

import math
import random

from pyspark.sql import functions as F

from fusemill.operators import ranking


def frames(spark):
    rng = random.Random(11)
    made = [[rng.choice([-1.0, -0.5, 0.25, 0.5000005, 1.0, 3e-7]) for _ in range(4)] for _ in range(60)]
    odd = [None, [1.0, None, 0.5, 1.0], [1.0, 2.0], [float("nan"), 1.0, 1.0, 1.0], [float("inf"), 1.0, 1.0, 1.0]]
    vectors = made + made[:20] + odd
    corpus = spark.createDataFrame(list(enumerate(vectors)), "chunk_id long, vec array<double>")
    asked = [(k, vectors[k]) for k in range(0, 60, 6)] + [(100, None), (101, [1.0, 1.0])]
    return spark.createDataFrame(asked, "question_id long, q_vec array<double>"), corpus


def plain(queries, corpus, k, threshold=None):
    scored = corpus.crossJoin(queries).select("question_id", "chunk_id", F.round(ranking.dot(F.col("vec"), F.col("q_vec")), 6).alias("score"))
    return ranking.top_k(scored if threshold is None else scored.where(F.col("score") >= threshold), k)


def rows(df):
    return sorted((r.question_id, r["rank"], r.chunk_id, "nan" if r.score is not None and math.isnan(r.score) else r.score) for r in df.collect())


def test_blocks_give_what_pairs_give(spark, monkeypatch):
    q, c = frames(spark)
    for queries, group in ((10_000, 8192), (3, 7)):
        monkeypatch.setattr(ranking, "QUERY_LIMIT", queries)
        monkeypatch.setattr(ranking, "CORPUS_ROWS", group)
        for k, threshold in ((5, None), (100, None), (3, 0.5)):
            assert rows(ranking.dense_search(q, c, k, threshold)) == rows(plain(q, c, k, threshold))
    assert ranking.dense_search(q.limit(0), c, 5).count() == 0 == ranking.dense_search(q, c.limit(0), 5).count()


def test_regular_vectors_meet_in_blocks(spark, capsys):
    q, c = (df.where(F.size(name) == 4).where(~F.exists(name, lambda x: x.isNull() | F.isnan(x))) for df, name in zip(frames(spark), ("q_vec", "vec"), strict=True))
    ranking.dense_search(q.limit(5), c.where("chunk_id < 80"), 5).explain()
    plan = capsys.readouterr().out
    assert "FlatMapCoGroups" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
