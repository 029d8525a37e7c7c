"""Records: verdicts, spans and routing at their edges; the phrase query over a whole table."""

from pyspark.sql import functions as F

import __spark_entry__
from fusemill.functions import records


def test_verdict(spark):
    ok = '{"response":{"status_code":200,"body":{"choices":[{"message":{"content":"%s"}}]}}}'
    cases = [(ok % '{\\"correct\\": true}', True), (ok % '{\\"correct\\": false}', False), (ok % '{\\"correct\\": \\"true\\"}', None), (ok % "nothing", None), ('{"error":"x"}', None), ("{", None), (None, None), ('{"response":{"status_code":200,"body":{"choices":[]}}}', None)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, line string")
    got = dict(df.select("i", records.verdict(F.col("line")).alias("v")).collect())
    assert [got[i] for i in range(len(cases))] == [c[1] for c in cases]


def test_evidence_span(spark):
    cases = [("b c", "a b c", (2, 5)), ("b  c", "a b\n c", (2, 5)), ("x", "abc", (-1, -1)), ("", "a", (-1, -1)), (None, "a", (-1, -1)), ("a", None, (-1, -1))]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, e string, t string")
    got = {r["i"]: tuple(r["s"]) for r in df.select("i", records.evidence_span(F.col("e"), F.col("t")).alias("s")).collect()}
    assert got == {i: c[2] for i, c in enumerate(cases)}


def test_route_edges(spark):
    rows = [("hybrid", None, 1, 0.9), ("hybrid", None, 1, 0.5), ("hybrid", None, 1, None), ("learned-soft", 1.7, None, None), ("learned-soft", None, None, None), ("hard-routing", None, 0, None), ("unknown", 0.5, 1, 0.9)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, w double, c int, k double")
    got = {r["i"]: r["d"] and tuple(r["d"]) for r in df.select("i", records.route(F.col("p"), F.col("w"), F.col("c"), F.col("k"), 0.7, 0.4).alias("d")).collect()}
    assert got == {0: (1.0, True, False, False), 1: (0.4, True, True, True), 2: None, 3: (1.0, True, True, False), 4: None, 5: (0.0, False, True, False), 6: None}


def test_phrase_query(spark):
    assert __spark_entry__.queries()["phrase_matches"](spark, "/root/testdata/sf0.001").count() > 0
