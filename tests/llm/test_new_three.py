"""Hard negatives, importance resampling and token counts against brute force, under odd rows, ties, copies and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fusemill.llm import hard_negatives, importance, queries, token_counts
from tests.llm.test_contracts import LONG, ODD_ROWS, SMALL, clashing, unharmed
from tests.llm.test_llm import docs_of

VECTORS = "vec_id bigint, label int, embedding array<double>"


def negatives_plain(rows, anchors, positives=5, k=5):
    rows = sorted({(i, y, tuple(v)) for i, y, v in rows if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)})
    out = set()
    for i, y, v in rows:
        if i not in anchors:
            continue
        scored = sorted((-int(sum(a * b for a, b in zip(v, w))), j, z) for j, z, w in rows if j != i)
        for p, j, _ in [s for s in scored if s[2] == y][:positives]:
            window = [s for s in scored if s[2] != y and 80 * -p <= 100 * -s[0] <= 100 * -p]
            out |= {(i, j, r, n, -p, -s) for r, (s, n, _) in enumerate(window[:k], 1)}
    return out


@pytest.mark.parametrize("kind", ["noise", "copies", "line"])
def test_hard_negatives_equal_brute_force(spark, kind):
    rng = np.random.default_rng(len(kind))
    if kind == "noise":
        v = rng.normal(size=(900, 6))
    elif kind == "copies":  # a third of the rows share one vector, others a few
        v = rng.normal(size=(12, 6))[np.where(rng.random(900) < 0.35, 0, rng.integers(0, 12, 900))]
    else:  # ties all along a line
        v = np.outer(rng.integers(-3, 4, 900), np.ones(6))
    rows = [(i, int(rng.integers(0, 3)), np.floor(256 * x).tolist()) for i, x in enumerate(v)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, VECTORS)
    small = {"leaf_rows": 60, "sample_rows": 300, "block_rows": 40}
    got = hard_negatives.mine(df, df.where("vec_id % 50 = 0"), **small)
    assert {tuple(r) for r in got.collect()} == negatives_plain(rows, set(range(0, 900, 50)))
    default = hard_negatives.mine(df, df.where("vec_id % 50 = 0"))
    assert default.count() == got.count()


def test_hard_negatives_odd_rows(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [2.0, 1.0]), (2, 2, [2.0, 2.0]), (3, None, [9.0, 9.0]), (4, 2, None), (5, 2, [float("nan"), 1.0]), (6, 2, [None, 1.0]), (None, 2, [2.0, 0.0]), (7, 2, []), (8, 2, [0.0, 0.0]), (100, 3, [1.0, 1.0])]
    df = spark.createDataFrame(rows, VECTORS)
    wide, _ = clashing(df, ("label",))
    got = hard_negatives.mine(wide, wide.where("vec_id % 100 = 0"))
    assert [tuple(r) for r in got.collect()] == [(0, 1, 1, 2, 2, 2)]
    assert hard_negatives.mine(df.limit(0), df.limit(0)).count() == 0 == hard_negatives.mine(df, df.limit(0)).count()


def test_tree_excludes_no_row_within_reach():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 16))[rng.integers(0, 30, 3000)] + 0.1 * rng.normal(size=(3000, 16))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True))
    top = float((x * x).sum(1).max())
    tree, leaf = hard_negatives.grow(hard_negatives.augmented(x, top), top, 64)
    assert (tree.deal(hard_negatives.augmented(x, top)) == leaf).all() and np.bincount(leaf).max() <= 64
    q = x[:40] + np.floor(rng.normal(size=(40, 16)) * 5)
    least, most = tree.scores(q)
    score = q @ x.T
    assert (score <= most[:, leaf] + 1e-9).all() and (score >= least[:, leaf] - 1e-9).all()
    assert (most < np.sort(score, axis=1)[:, -5:-4]).mean() > 0.5  # half of the leaves at least aren't read for five neighbours


def words_plain(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def resampled_plain(docs, target):
    def features(text):
        w = words_plain(text)
        return [zlib.crc32(x.encode()) % 10_000 for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text))
    for text in target:
        t.update(features(text))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in range(10_000)]
    rows = []
    for i, text in docs:
        f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 39), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = Counter()
    place = {}
    for k, r in enumerate(able[: 25 * len(able) // 100], 1):
        place[r, rank[r]] = k
        rank[r] += 1
    seen = Counter()
    out = []
    for r in rows:
        out.append((*r, place.get((r, seen[r]))))
        seen[r] += 1
    return out


def order(rows):
    return sorted(rows, key=str)


def test_importance_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want = resampled_plain(docs, target)
    got = queries.QUERIES["op12_importance"](spark, SMALL)
    assert order(map(tuple, got.collect())) == order(want)
    both = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    kept = importance.drawn(*both)
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in want if r[4]} and set(both[0].columns) < set(kept.columns)


def test_importance_of_odd_rows(spark, monkeypatch):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choices(["Alpha", "beta's", "ÉTÉ", "中文", "x1", "--", "Straße"], k=n))
    rows = [(k, text(rng.randint(15, 60))) for k in range(80)]
    rows += [(3, rows[3][1]), (3, text(30)), (None, text(40)), (None, None), (200, ""), (201, None), (202, "..."), *[(300 + k, rows[0][1]) for k in range(40)]]
    target = [(1, "beta alpha x1"), (2, None)]
    wide, extra = clashing(docs_of(spark, rows), ("text",))
    to = spark.createDataFrame(target, "item_id bigint, text string")
    want = resampled_plain(rows, [t for _, t in target])
    assert order(map(tuple, importance.resample(wide, to).collect())) == order(want)
    kept = importance.drawn(wide, to).collect()
    assert Counter(r.doc_id for r in kept) == Counter(r[0] for r in want if r[4]) and unharmed(kept, extra, ("n_features", "weight", "score"))
    assert importance.resample(wide.limit(0), to).count() == 0 == importance.drawn(wide.limit(0), to).count()
    assert importance.resample(wide, to.limit(0)).count() == len(rows)
    whole = np.concatenate(list(importance.features(LONG.encode())))
    monkeypatch.setattr(importance, "WINDOW", 1000)
    cut = np.concatenate(list(importance.features(LONG.encode())))
    assert (np.bincount(whole, minlength=10_000) == np.bincount(cut, minlength=10_000)).all() and len(whole) == 2 * len(LONG.split()) - 1


@pytest.fixture(scope="module", params=["word_bpe_49k.json", "byte_bpe_50k.json"])
def library(request):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(request.param)
    return path, Tokenizer.from_file(path)


PIECES = ["a", "b", "aaaa", "the", " ", "  ", "\n", " ", "\x1c", "\x1f", "\x85", " ", "é", "́", "İ", "Σ", "<|endoftext|>", "<|startoftext|>", "<|endof", "'s", "'re", "!!", "=====", "1", "٣", "漢", "\U0001f642", "‍", "ﬁ", "᠎", "\x00", "﻿", "<", "|", ">"]


def test_token_counts_equal_the_library(library, monkeypatch):
    path, lib = library
    rng = random.Random(1)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(rng.choices("abcdefgh", k=9000)), "a" * 10_001, "=" * 7777 + "!" * 5000, "漢字" * 4000, "ab" * 3000, LONG[:200_000]]
    want = [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    assert token_counts.Counter(path).count(texts) == want
    monkeypatch.setattr(token_counts, "WINDOW", 500)
    monkeypatch.setattr(token_counts, "TABLE_BYTES", 40_000)
    monkeypatch.setattr(token_counts, "LONG", 12)
    c = token_counts.Counter(path)
    assert c.count(texts) == want
    assert c.taken <= 40_000


def test_token_count_query_and_odd_rows(spark, library):
    path, lib = library
    n = lambda t: len(lib.encode(t or "", add_special_tokens=False).ids)
    docs, extra = clashing(docs_of(spark, [*ODD_ROWS, (9, LONG), (10, "<|endoftext|>")]), ("text",))
    out = token_counts.token_counts(docs, path)
    rows = out.collect()
    assert unharmed(rows, extra, ("n_bytes", "n_tokens", "over_limit")) and len(rows) == len(ODD_ROWS) + 2
    assert all((r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n(r.text), n(r.text) > 2048) for r in rows)
    assert token_counts.token_counts(docs.limit(0), path).count() == 0
    if path.endswith("word_bpe_49k.json"):
        texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
        got = queries.QUERIES["op13_token_counts"](spark, SMALL).collect()
        assert len(got) == len(texts) and all(r.n_tokens == n(texts[r.doc_id]) and r.n_bytes == len(texts[r.doc_id].encode()) for r in got)


def test_vectors_are_quantised_downwards(spark):
    row = spark.sql("SELECT array(CAST(-0.001 AS FLOAT), CAST(0.5 AS FLOAT)) AS v").select(hard_negatives.quantised(F.col("v")).alias("v")).first()
    assert row.v == [-1.0, 128.0]
