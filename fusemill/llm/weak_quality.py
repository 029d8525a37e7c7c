"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document; expectation-maximisation over the counts of their vote patterns
estimates each labeller's accuracies without any true label, and the posterior of a pattern labels its documents. A hashed linear
scorer is trained on those posteriors and scores every document.

The pattern counts cover all documents: at most 3 ** labellers rows come to the driver, whatever the input. The scorer is fitted on a
bounded sample (``sample_rows`` documents of small hashes of id and text: each document decides for itself by a threshold, so the sample takes no sort and no
shuffle), from the filled places of feature vectors made on the executors; all documents are scored, whole texts, without a shuffle.

Defined results: null text counts as empty (n_words 0, no features: the scorer's bias decides); null ids pass; repeated rows and ties are scored
alike; texts of any length are scored whole; an empty table gives an empty result with an untrained model; further columns pass under any name, one named
quality or kept is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fusemill.llm import quality_rules
from fusemill.llm.common import named

GOOD, BAD, ABSTAIN = 1, 0, -1
DIM = 2048
#: Frequent function words of English, French, German and Spanish (fixed values).
FUNCTION_WORDS = "the of and to in is for that et les la le de des un une que der die und das ist den von el los en y por".split()


def votes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Input columns, the counts of the quality rules, and one column v_* for each labeller."""
    df = quality_rules.with_counts(docs, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = F.col("n_words")
    lines = F.regexp_count(text, F.lit("\n")) + 1
    ended = F.regexp_count(text, F.lit(r"[.!?…:;][\"'”’»)]*\s*(\n|$)"))
    capitals = F.regexp_count(text, F.lit(r"[A-ZÀ-Þ]{2}"))
    function_words = F.regexp_count(text, F.lit(r"(?i)(?<!\S)(" + "|".join(FUNCTION_WORDS) + r")(?!\S)"))

    def vote(bad: Column, good: Column | None = None) -> Column:
        out = F.when(bad, BAD)
        return F.coalesce((out.when(good, GOOD) if good is not None else out).otherwise(ABSTAIN), F.lit(ABSTAIN)).cast("int")

    return df.withColumns(
        {
            "v_length": vote(n < 50),
            "v_symbols": vote(F.col("n_symbols") * 20 > n, F.col("n_symbols") * 100 <= n),
            "v_repeats": vote(F.col("n_repeat_words") * 3 > n, F.col("n_repeat_words") * 10 <= n),
            "v_lines": vote((F.col("n_dup_lines") > 3) & (F.col("n_dup_lines") * 3 > lines)),
            "v_marks": vote(ended * 3 < lines, ended * 5 >= lines * 3),
            "v_capitals": vote(capitals * 5 > n, capitals * 50 <= n),
            "v_function": vote(function_words * 50 < n, function_words * 12 >= n),
        }
    )


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over vote patterns: share of good documents, P(vote | class) as [labeller, class, vote], posterior of each pattern."""
    labellers = patterns.shape[1]
    share = (patterns == GOOD).sum(1) / np.maximum(1, (patterns != ABSTAIN).sum(1))
    post = np.where((patterns == BAD).any(1), 0.3 * share, 0.5 + 0.5 * share)  # start: any bad vote leans to bad
    p, table = 0.5, np.full((labellers, 2, 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post])
        p = float(np.clip(weight[1].sum() / max(1e-9, counts.sum()), 0.01, 0.99))
        for j in range(labellers):
            for v in (BAD, GOOD, ABSTAIN):
                table[j, :, v] = weight[:, patterns[:, j] == v].sum(1) + 0.5
            table[j] /= table[j].sum(1, keepdims=True)
        log = np.log([[1 - p], [p]]) + sum(np.log(table[j][:, patterns[:, j]]) for j in range(labellers))
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return p, table, post


_CLASS = np.full(256, 3, dtype=np.int64)
_CLASS[0x30:0x3A], _CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x80:] = 2, 1, 0, 0
for _k, _c in enumerate(b".,;:!?"):
    _CLASS[_c] = 4 + (_k > 3)


def features(text: str | None) -> np.ndarray:
    """Hashed features of a whole text, in means over its words: words, word shapes, repeats of the word before."""
    out = np.zeros(DIM, dtype=np.float32)
    data = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return out
    length = end - start
    first, last = _CLASS[data[start]], _CLASS[data[end - 1]]
    at = np.arange(len(data), dtype=np.uint64)
    place = at - np.repeat(start, np.diff(np.append(start, len(data)))).astype(np.uint64) if start[0] == 0 else None
    if place is None:
        place = np.concatenate([np.zeros(start[0], np.uint64), at[start[0] :] - np.repeat(start, np.diff(np.append(start, len(data)))).astype(np.uint64)])
    mixed = (data.astype(np.uint64) + np.uint64(1)) * ((place * np.uint64(2654435761) + np.uint64(40503)) | np.uint64(1)) * inside
    word = np.add.reduceat(mixed, start)
    symbols = np.add.reduceat(((_CLASS[data] == 3) & inside).astype(np.int64), start)
    shape = ((first * 8 + last) * 8 + np.minimum(length // 2, 7)) * 3 + np.minimum(symbols, 2)
    half = DIM // 2
    scale = 1.0 / len(start)
    out[:half] = np.bincount((word % np.uint64(half)).astype(np.int64), minlength=half) * scale
    out[half : 2 * half - 8] = np.bincount(shape % (half - 8), minlength=half - 8) * scale
    out[-1] = float((word[1:] == word[:-1]).mean()) if len(word) > 1 else 0.0
    out[-2] = 1.0 / (1 + len(start) / 50)
    out[-3] = 1.0 - len(np.unique(word)) / len(word)
    return out


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -50, 50)))


def train(x: np.ndarray, target: np.ndarray, rounds: int = 300, rate: float = 0.05, l2: float = 1e-5) -> Scorer:
    """Logistic regression on soft targets (Adam, full batch), on features scaled by their spread."""
    scale = 1.0 / np.maximum(x.std(0), 0.01) if len(x) else np.ones(DIM)
    mean = x.mean(0) if len(x) else np.zeros(DIM)
    z = (x - mean) * scale
    w, b = np.zeros(x.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1 if len(x) else 1):
        gap = 1 / (1 + np.exp(-np.clip(z @ w + b, -50, 50))) - target
        g = np.append(z.T @ gap / len(z) + l2 * w, gap.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Scorer((w * scale).astype(np.float64), float(b - (mean * scale) @ w))


@dataclass
class Model:
    scorer: Scorer
    prior: float
    votes: np.ndarray
    posterior: dict[tuple[int, ...], float]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 4000) -> Model:
    """Fit labeller accuracies on all documents, and the scorer on ``sample_rows`` of them at most."""
    voted = votes(docs.select(named(text_col).alias("text")), "text")
    names = [c for c in voted.columns if c.startswith("v_")]
    rows = voted.groupBy(*names).count().collect()
    patterns = np.array([[r[n] for n in names] for r in rows], dtype=int).reshape(len(rows), len(names))
    prior, table, post = fit_labellers(patterns, np.array([r["count"] for r in rows], dtype=float))
    posterior = {tuple(p): float(q) for p, q in zip(patterns.tolist(), post, strict=True)}
    total = sum(r["count"] for r in rows)
    hashed = F.pmod(F.xxhash64(named(id_col), named(text_col)), F.lit(1 << 32))
    bound = int(min(1.0, 1.05 * sample_rows / max(1, total)) * (1 << 32))
    chosen = docs.select(named(text_col).alias("text"), hashed.alias("h")).where(F.col("h") <= bound)
    # rows that repeat one another share a hash; the limit holds what comes to the driver in bounds
    filled = F.pandas_udf(_filled, "struct<at:array<int>,x:array<float>>")(F.col("text")).alias("f")
    made = votes(chosen, "text").select("h", *names, filled).limit(2 * sample_rows).collect()
    made = sorted(made, key=lambda r: (r["h"], r["f"]["at"]))[:sample_rows]
    x = np.zeros((len(made), DIM))
    for k, r in enumerate(made):
        x[k, r["f"]["at"]] = r["f"]["x"]
    target = np.array([posterior.get(tuple(r[n] for n in names), prior) for r in made])
    return Model(train(x, target), prior, table, posterior)


def _filled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        each = [features(t) for t in texts]
        at = [np.flatnonzero(f).astype(np.int32) for f in each]
        yield pd.DataFrame({"at": at, "x": [f[k] for f, k in zip(each, at, strict=True)]})


def classify(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Input columns plus quality (0 to 1, by the scorer) and kept."""
    scorer = model.scorer

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([float(scorer.score(features(t)[None, :].astype(np.float64))[0]) for t in texts], dtype="float64")

    out = docs.withColumn("quality", F.pandas_udf(run, "double")(named(text_col)))
    return out.withColumn("kept", F.col("quality") >= threshold)
