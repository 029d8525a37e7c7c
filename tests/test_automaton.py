"""Stored dictionaries: the same matches as the join and a plain scan, titles in order, and when an artifact is built anew."""

import os
import random

import pytest

from fusemill.operators import automaton, phrases
from fusemill.plans import automaton_queries, record_queries  # noqa: F401
from fusemill.registry import QUERIES
from tests.test_phrases import scan

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
RECORD = "match_key string, canonical string, df int, prio int"


def dictionary(spark, keys):
    return spark.createDataFrame([(k, k.upper(), i % 3, 0) for i, k in enumerate(keys)], RECORD)


@pytest.mark.parametrize("limits", [{}, {"part_chars": 20}], ids=["one part", "many parts"])
def test_equals_scan_and_join(spark, tmp_path, limits):
    rng = random.Random(11)
    parts = ["a", "ab", "b", " ", " ", "é", "-", "(", ")", "_", "1", "ab a", "b-a", "\U0001f600"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 40))) for _ in range(150)] + ["", None, "new yorkers in new york", "ab ab ab"]
    keys = sorted({"".join(rng.choices(parts, k=rng.randrange(1, 5))).strip() for _ in range(40)} - {""} | {"new york", "new", "(", "ab ab"})
    frame = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    path = automaton.stored(dictionary(spark, keys), str(tmp_path), **limits)
    got = sorted(tuple(r) for r in automaton.matches(frame, path, "doc", "text").collect())
    assert [(i, s, e, k) for i, s, e, k, *_ in got] == sorted((i, *m) for i, t in enumerate(texts) for m in scan(t or "", keys))
    assert got == sorted(tuple(r) for r in automaton.matches(frame, path, "doc", "text", broadcast_bytes=0).collect())
    assert got == sorted(tuple(r) for r in phrases.matches(frame, dictionary(spark, keys), "doc", "text").collect())


def test_built_once_while_the_fingerprint_holds(spark, tmp_path):
    keys = ["one", "two", "three"]
    path = automaton.stored(dictionary(spark, keys), str(tmp_path))
    before = {f: os.stat(os.path.join(path, "tries", f)).st_mtime_ns for f in os.listdir(f"{path}/tries")}
    again = automaton.stored(dictionary(spark, keys).repartition(3).orderBy("match_key"), str(tmp_path))
    assert again == path
    assert before == {f: os.stat(os.path.join(path, "tries", f)).st_mtime_ns for f in os.listdir(f"{path}/tries")}
    assert automaton.stored(dictionary(spark, [*keys, "four"]), str(tmp_path)) != path


def test_half_an_artifact_is_not_used(spark, tmp_path):
    path = automaton.stored(dictionary(spark, ["one"]), str(tmp_path))
    os.rename(f"{path}/done", f"{path}/undone")
    with pytest.raises(ValueError, match="no whole artifact"):
        automaton.matches(spark.createDataFrame([(1, "one")], "id int, text string"), path, "id", "text")
    assert automaton.stored(dictionary(spark, ["one"]), str(tmp_path)) == path
    assert automaton.matches(spark.createDataFrame([(1, "one")], "id int, text string"), path, "id", "text").count() == 1


def test_nothing_in_nothing(spark, tmp_path):
    path = automaton.stored(spark.createDataFrame([(None, "x", 1, 1), ("", "x", 1, 1), (" lead", "x", 1, 1)], RECORD), str(tmp_path))
    assert automaton.matches(spark.createDataFrame([(1, "x lead"), (2, None)], "id int, text string"), path, "id", "text").collect() == []


def test_titles_by_first_occurrence_with_aliases_and_limit(spark, tmp_path):
    titles = spark.createDataFrame([("New York",), ("Paris",), ("paris ",), ("",), (None,), ("Big Apple Pie",)], "title string")
    alias = spark.createDataFrame([("The Big Apple", "new york"), ("Paname", "Paris"), ("nowhere", "Atlantis"), ("Paris", "New York"), (None, "Paris")], "alias string, canonical string")
    path = automaton.stored(automaton.title_dictionary(titles, alias), str(tmp_path))
    texts = spark.createDataFrame([(1, "PANAME, then the big apple; Paris, New York."), (2, "Parisian nowhere big apple pie"), (3, ""), (4, None)], "id int, text string")
    got = sorted(tuple(r) for r in automaton.titles_in_order(texts, path).collect())
    assert got == [(1, 1, "Paris"), (1, 2, "New York"), (2, 1, "Big Apple Pie")]
    assert sorted(tuple(r) for r in automaton.titles_in_order(texts, path, most=1).collect()) == [(1, 1, "Paris"), (2, 1, "Big Apple Pie")]


def test_query_gives_the_rows_of_the_join(spark):
    ours, join = (QUERIES[n](spark, SF_DIR) for n in ("automaton_matches", "phrase_matches"))
    got = sorted(tuple(r) for r in ours.collect())
    assert got and got == sorted(tuple(r) for r in join.select(*ours.columns).collect())
