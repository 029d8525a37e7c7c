"""Maximal munch against a plain scan, and ranking of the matches."""

import random

from fusemill.operators import phrases


def scan(text, keys):
    out, i = [], 0
    while i < len(text):
        best = max((k for k in keys if text.startswith(k, i)), key=len, default=None)
        end = i + len(best) if best else i
        cut = best and ((i and text[i - 1].isalnum() and text[i].isalnum()) or (end < len(text) and text[end - 1].isalnum() and text[end].isalnum()))
        if best is None or cut or text[i].isspace():
            i += 1
        else:
            out.append((i, end, best))
            i = end
    return out


def run(spark, texts, keys):
    d = spark.createDataFrame([(k, k.upper(), i % 3, 0) for i, k in enumerate(keys)], "match_key string, canonical string, df int, prio int")
    got = phrases.matches(spark.createDataFrame(list(enumerate(texts)), "doc int, text string"), d, "doc", "text").collect()
    return {i: sorted((r["start"], r["end"], r["match_key"]) for r in got if r["id"] == i) for i in range(len(texts))}


def test_equals_scan(spark):
    rng = random.Random(7)
    parts = ["a", "ab", "b", " ", " ", "é", "-", "(", ")", "_", "1", "ab a", "b-a"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 40))) for _ in range(150)] + ["", "new yorkers in new york", "ab ab ab"]
    keys = sorted({"".join(rng.choices(parts, k=rng.randrange(1, 5))).strip() for _ in range(40)} - {""} | {"new york", "new", "(", "ab ab"})
    got = run(spark, texts, keys)
    assert got == {i: scan(t, keys) for i, t in enumerate(texts)}


def test_null_empty_and_cap(spark):
    assert run(spark, [None, ""], ["a"]) == {0: [], 1: []}
    assert run(spark, ["a"], []) == {0: []}
    d = spark.createDataFrame([("x", "X", 9, 0), ("y z", "Y", 1, 0), ("w", "W", 1, 0), ("v", "W", 1, 1)], "match_key string, canonical string, df int, prio int")
    found = phrases.matches(spark.createDataFrame([(1, "x w v y z")], "doc int, text string"), d, "doc", "text")
    assert [(r["rank"], r["canonical"]) for r in phrases.rank_and_cap(found).orderBy("rank").collect()] == [(1, "Y"), (2, "W")]
    assert [r["canonical"] for r in phrases.rank_and_cap(found, most=1, max_df=None).collect()] == ["Y"]


def test_only_places_of_first_runs_leave_a_text(spark):
    long = "word other " * 40_000 + "new york"
    texts = spark.createDataFrame([(1, long), (2, None), (3, "new " * 40_000)], "id int, text string")
    keys = spark.createDataFrame([("new",)], "stem string")
    got = phrases.places(texts, keys, 8).collect()
    assert len(got) == 40_001 and {r.stem for r in got} == {"new"}
    assert [(r.start, r.ahead) for r in got if r.id == 1] == [(440_000, "new york")]
