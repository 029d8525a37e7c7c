"""Text forms, spans and similarities against worked examples."""

import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from fusemill.functions import text
from fusemill.operators import containment


def column(spark, values, make, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r.x for r in spark.createDataFrame(rows, f"i int, t {kind}").repartition(1).sortWithinPartitions("i").select(make(F.col("t")).alias("x")).collect()]


def test_entity_keys(spark):
    asked = ["The Hunger Games", "Jean-Luc Picard", "ʿAḍud al-Dawla", "Paris (Texas)", "Rock's end", "The a an X", "Straße!", "AT&T", None]
    want = ["hunger games", "jean-luc picard", "adud al-dawla", "paris", "rock end", "x", "strasse", "at t", None]
    assert column(spark, asked, text.entity_key) == want


def test_matching_forms_fold_case(spark):
    assert column(spark, ["STRASSE ( but  third )", "Straße (but third)", "ΣΊΣΥΦΟΣ a | b .", "ıI"], text.matching_form) == ["strasse (but third)", "strasse (but third)", "σίσυφοσ a b.", "ıi"]
    assert column(spark, ["The Hunger  Games", "Café ( x ) ,", "ʿAḍud"], text.query_form) == ["the hunger games", "cafe (x),", "adud"]
    assert column(spark, ["a  b [ ˈ 12 ] c (Listen) d", None], text.extraction_form) == ["a b c d", ""]
    assert column(spark, [" a/b ", "//", ""], text.path_segment) == ["a-b", "unknown", "unknown"]


def shape(label):
    toks = label.lower().split()
    n = len(toks)
    length = 0.55 if n <= 1 else 0.75 + 0.05 * (n - 2) if n <= 5 else max(0.45, 0.95 - 0.04 * (n - 5))
    digits = sum(c.isdigit() for c in label) / len(label)
    stops = sum(t in text.LABEL_STOP_WORDS for t in toks) / n
    letters = sum(c.isalpha() for c in label) / len(label)
    return max(0.05, min(1.0, length * (1 - min(0.85, 2 * digits)) * (1 - min(0.5, 1.2 * stops)) * (0.55 + 0.45 * min(1.0, letters))))


def test_label_shape(spark):
    labels = ["real madrid", "1999", "the of and", "x", "supreme court of the united states of america today", "naïve café 12"]
    for got, label in zip(column(spark, labels, text.label_shape), labels, strict=True):
        assert math.isclose(got, shape(label), rel_tol=1e-12), label
    assert column(spark, ["", "  "], text.label_shape) == [0.05, 0.05]


def test_sentence_spans_of_any_text(spark):
    texts = ["a\ue000b. \ue001c", ". . x", "one.  two!\n\nthree? ", "  lead. \U0001f600 end.", "...", "a.b. c", None]
    cut = [[(0, 4), (5, 7)], [(0, 1), (2, 3), (4, 5)], [(0, 4), (6, 10), (12, 18)], [(0, 7), (8, 14)], [(0, 3)], [(0, 4), (5, 6)]]
    got = column(spark, texts, text.sentence_spans)
    assert [[tuple(x) for x in g] for g in got[:-1]] == cut and got[-1] is None


def test_sentence_spans(spark):
    t = "One two.  Three? Four\nfive! "
    spans = column(spark, [t, "", "no end"], text.sentence_spans)
    assert [t[s["start"] : s["end"]] for s in spans[0]] == ["One two.", "Three?", "Four\nfive!"]
    assert spans[1] == [] and [tuple(s) for s in spans[2]] == [(0, 6)]
    around = column(spark, [t], lambda c: text.span_around(text.sentence_spans(c), F.lit(11), F.lit(14)))
    assert tuple(around[0]) == (10, 16)
    assert column(spark, [t], lambda c: text.span_around(text.sentence_spans(c), F.lit(5), F.lit(12))) == [None]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0, *_next(row, x, b)]
    return row[-1]


def _next(above, x, b):
    out = [0]
    for j, y in enumerate(b, 1):
        out.append(above[j - 1] + 1 if x == y else max(above[j], out[-1]))
    return out[1:]


def test_rouge_l(spark):
    pairs = [("the cat sat", "the cat sat"), ("a b c d e", "b x d e"), ("", "a"), ("a", ""), ("A b", "a B c"), ("p q", "r s")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: r.f for r in df.select("i", text.rouge_l(F.col("a"), F.col("b")).alias("f")).collect()}
    for i, (a, b) in enumerate(pairs):
        x, y = a.lower().split(), b.lower().split()
        want = 2 * lcs(x, y) / (len(x) + len(y)) if x and y else 0.0
        assert math.isclose(got[i], want), pairs[i]
    assert got[0] == 1.0


def test_entity_list(spark):
    got = column(spark, ['```json\n["A", " B ", "A", ""]\n```', "none", None, "[1"], text.entity_list)
    assert got == [["A", "B"], [], [], []]


def test_containment_finds_needles_of_any_length(spark):
    import random

    rng = random.Random(2)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 12))) for _ in range(40)] + ["x" * 30]
    hay = [(i, rng.choice([" ", "  ", "\n"]).join(rng.choices(words, k=60))) for i in range(40)] + [(40, ""), (41, None)]
    needles = ["not there at all anywhere", "abcabcabc bcabcabca", "", " ", None, "a", "x", "xx", "c a", "a  b", " a", "b ", "x" * 30, "x" * 31, "é"]
    for _ in range(300):
        t = rng.choice(hay[:40])[1]
        a = rng.randrange(len(t))
        needles.append(t[a : a + rng.choice([1, 2, 3, 5, 9, 17, 40])])
    texts, asked = spark.createDataFrame(hay, "id int, hay string"), spark.createDataFrame([(n,) for n in needles], "needle string")
    want = sorted((i, n) for i, t in hay if t for n in {n for n in needles if n and n.strip()} if n in t)
    assert sorted((r.id, r.needle) for r in containment.found(texts, asked).collect()) == want
    assert sorted(r.needle for r in containment.standing(texts, asked).collect()) == sorted({n for _, n in want})


def test_containment_scans_and_join_agree(spark, capsys):
    hay = [(1, "ein Haus am See\u00a0x \U0001f600b"), (2, "am  See am See"), (3, ""), (4, None)]
    texts = spark.createDataFrame(hay, "id long, hay string")
    asked = ["am See", "See", " a", "m  S", "", " ", None, "\u00a0", "\U0001f600", "\U0001f600b", "See", "Haus am See", "no", "n H"]
    needles = spark.createDataFrame([(n,) for n in asked], "needle string")
    want = sorted((i, n) for i, t in hay for n in {n for n in asked if n and n != " "} if n in (t or ""))
    for how in ({}, {"scan_chars": 10}, {"scans": 0}):
        assert sorted(tuple(r) for r in containment.found(texts, needles, **how).collect()) == want
    assert containment.found(texts, needles.where("needle = ' '")).collect() == []
    containment.found(texts, needles).explain()
    plan = capsys.readouterr().out
    assert "MapInPandas" in plan and "Exchange" not in plan


def test_keep_rules_and_coverage(spark):
    hay = spark.createDataFrame([(1, "this corpus contains alpha and other content"), (2, "table style beta gamma values"), (3, None)], "id int, hay string")
    rows = [("k", "nq", ["alpha", "missing"]), ("d", "nq", ["not present"]), ("w", "2wiki", ["beta", "gamma"]), ("v", "2wiki", ["beta", "not present"]), ("h", "hotpotqa", ["beta", "gamma"]), ("e", "nq", []), ("n", "2wiki", None), ("s", "nq", ["a"])]
    items = spark.createDataFrame(rows, "id string, src string, needles array<string>")
    assert {r.id for r in containment.any_all(items, hay).collect() if r.keep} == {"k", "w", "h", "s"}
    texts = spark.createDataFrame([(1, "The Capital is PARIS\nand  Rome"), (2, None)], "id int, text string")
    asked = [("a", [" paris "]), ("b", ["", "Rome", None]), ("c", ["is paris and"]), ("d", []), ("e", None), ("f", ["L is p"]), ("g", ["and  rome"])]
    got = containment.covered(spark.createDataFrame(asked, "id string, answers array<string>"), texts).collect()
    assert {r.id for r in got if r.covered} == {"a", "b", "f", "g"} and len(got) == 7


def test_case_folding_is_that_of_unicode(spark):
    letters = [chr(c) for c in range(0x20, 0x20000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) in ("Lu", "Ll", "Lt", "Nl", "So", "Mn")]
    texts = ["".join(letters[k : k + 40]) for k in range(0, len(letters), 40)] + ["ΟΔΟΣ ΟΔΟΣ", "Straße", "\U0001f600ß"]
    got = column(spark, texts, text.casefold)
    wrong = {c for t, g in zip(texts, got) if g != t.casefold() for c in t}
    # letters newer than the JVM's Unicode have no lower case there
    new = {c for c in wrong if c.lower() != c and column(spark, [c], text.casefold)[0] == c}
    assert [g for t, g in zip(texts, got) if not set(t) & new] == [t.casefold() for t in texts if not set(t) & new] and len(new) < 60


def test_containment_has_no_nested_loop(spark, capsys):
    a, b = spark.createDataFrame([(1, "a b c d")], "id int, hay string"), spark.createDataFrame([("b c d",)], "needle string")
    containment.found(a, b).explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("value, want", [("foo answer: bar", "bar"), ("ANSWER: a\nAnswer: b", "b"), ("none", "none")])
def test_last_answer(spark, value, want):
    assert column(spark, [value], text.last_answer) == [want]
