"""Artifacts of runs, batch records, entities, alignment and comparisons against worked examples."""

import json
import math

import pytest
from pyspark.sql import functions as F

from fusemill.functions import batch
from fusemill.operators import alignment, compare, entities
from fusemill.sources import artifacts


def lines(tmp_path, name, rows):
    path = f"{tmp_path}/{name}"
    with open(path, "w") as f:
        f.write("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return path


def chunk(i, s, t="x"):
    return {"chunk_id": i, "text": t, "score": s}


def test_retrieval_cache(spark, tmp_path):
    rows = [
        {"question_id": "a", "status": "OK", "chunks": [chunk("z", 1.0), chunk("b", 2.0), chunk("a", 1.0)]},
        {"question_id": "b", "status": "OK", "chunks": []},
        {"question_id": "c", "status": "ERROR", "error": "x"},
        {"question_id": "c", "status": "OK", "chunks": [chunk("k", 0.5)]},
        "{broken",
        {"status": "OK"},
    ]
    out = {r.question_id: r for r in artifacts.retrieval_cache(spark, lines(tmp_path, "c.jsonl", rows)).collect()}
    assert [(c.chunk_id, c["rank"]) for c in out["a"].chunks] == [("b", 0), ("a", 1), ("z", 2)]
    assert out["b"].status == "NO_CONTEXT" and out["c"].status == "OK" and len(out) == 3
    cut = {r.question_id: r for r in artifacts.trimmed(artifacts.retrieval_cache(spark, lines(tmp_path, "c.jsonl", rows)), 1).collect()}
    assert [c.chunk_id for c in cut["a"].chunks] == ["b"]


def test_readers_and_writers(spark, tmp_path):
    pred = artifacts.prediction_rows(spark, lines(tmp_path, "p.jsonl", [{"question_id": "a", "predicted_weight": 0.5}, {"question_id": "b", "predicted_weight": "x"}, {"question_id": "c"}])).collect()
    assert [(r.question_id, r.predicted_weight) for r in pred] == [("a", 0.5)]
    assert {r.title for r in artifacts.titles(spark, lines(tmp_path, "t.txt", [" A ", "B", "A", ""])).collect()} == {"A", "B"}
    assert {r.title for r in artifacts.titles(spark, lines(tmp_path, "t.jsonl", [{"title": "A"}, {"x": 1}])).collect()} == {"A"}
    assert artifacts.corpus_chunks(spark, lines(tmp_path, "k.jsonl", [{"chunk_id": "1", "text": "t"}])).count() == 1
    with pytest.raises(ValueError):
        artifacts.corpus_chunks(spark, lines(tmp_path, "e.jsonl", ["{"]))
    trials = artifacts.trial_rows(spark, lines(tmp_path, "r.jsonl", [{"trial_index": 1, "overrides": {"t": "2"}}, "bad", {"trial_index": 0, "overrides": {"a": "1"}}]))
    board = artifacts.leaderboard(trials).collect()
    assert [r.trial_index for r in board] == [0, 1] and (board[0].a, board[0].t, board[1].t) == ("1", None, "2")
    artifacts.write_leaderboard(trials, f"{tmp_path}/board")
    assert spark.read.option("header", True).csv(f"{tmp_path}/board").columns[-2:] == ["a", "t"]
    assert {r.question_id for r in artifacts.labelled_ids(spark, lines(tmp_path, "l.jsonl", [{"question_id": "a"}, {"question_id": "a"}, "x", {"question_id": " "}])).collect()} == {"a"}
    df = spark.createDataFrame([("a", "train")], "question_id string, split string")
    artifacts.write_rows(df, f"{tmp_path}/j")
    artifacts.write_rows(df, f"{tmp_path}/j", append=True)
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    artifacts.write_rows(df, f"{tmp_path}/j")
    artifacts.write_split_predictions(df, f"{tmp_path}/s")
    artifacts.write_table(df, f"{tmp_path}/q")
    assert spark.read.json(f"{tmp_path}/j").count() == spark.read.json(f"{tmp_path}/s/split=train").count() == spark.read.parquet(f"{tmp_path}/q").count() == 1
    artifacts.write_manifest(spark, f"{tmp_path}/m", {"b": 1, "a": "é"})
    assert spark.read.text(f"{tmp_path}/m").first().value == '{"a": "é", "b": 1}'
    one = artifacts.corpus_manifest(df.union(df.select(F.lit("b"), F.lit("x"))), {"index": "i"})
    assert one == artifacts.corpus_manifest(df.select(F.lit("b").alias("question_id"), F.lit("x").alias("split")).union(df), {"index": "i"}) and one["chunks"] == 2
    meta = spark.createDataFrame([(0, "c0"), (1, "c1")], "row_id int, chunk_id string")
    hits = spark.createDataFrame([("q", 0, 0.5), ("q", 1, 0.4), ("q", 9, 0.3)], "question_id string, row_id int, score double")
    texts = spark.createDataFrame([("c0", "t"), ("c1", " ")], "chunk_id string, text string")
    assert [r.chunk_id for r in artifacts.vector_hits(hits, meta, texts).collect()] == ["c0"]
    meta.withColumn("year", F.lit(1)).write.parquet(f"{tmp_path}/v")
    assert artifacts.vector_meta(spark, f"{tmp_path}/v").columns == ["row_id", "chunk_id"]
    ids = artifacts.numbered(spark.range(50).select((F.col("id") * 7 % 50).alias("x")), "x").collect()
    assert sorted((r.x, r.row_id) for r in ids) == [(k, k) for k in range(50)]


def test_numbers_of_many_rows(spark):
    n = 600_001
    rows = spark.range(n, numPartitions=8).select((F.col("id") * 7919 % n).alias("x"), F.sha2(F.col("id").cast("string"), 512).alias("more"))
    assert artifacts.numbered(rows, "x").where("x <> row_id").count() == 0
    odd = spark.createDataFrame([(None,), (3,), (1,), (None,)], "x int")
    assert sorted((r.row_id, r.x) for r in artifacts.numbered(odd, "x").collect()) == [(0, 1), (1, 3), (2, None), (3, None)]


def test_steps_and_resume(spark):
    steps = spark.createDataFrame([("ingest", 0, 100), ("corpus_filter", 90, 50), ("other", 50, 55)], "step string, before int, after int")
    out = artifacts.with_step(steps, spark.createDataFrame([("align", 100, 90), ("corpus_filter", 90, 60)], steps.schema))
    assert [(r.step, r.after) for r in out.collect()] == [("ingest", 100), ("align", 90), ("corpus_filter", 60), ("other", 55)]
    t = artifacts.step_totals(out).first()
    assert (t.start, t.end, t.added, t.dropped, t.net) == (0, 55, 105, 40, 55)
    q = spark.createDataFrame([("a",), ("b",), ("c",)], "question_id string")
    cache = spark.createDataFrame([("a", "OK")], "question_id string, status string")
    got = artifacts.retried(q, cache, lambda todo: todo.where("question_id = 'b'").withColumn("status", F.lit("OK"))).collect()
    assert {(r.question_id, r.status) for r in got} == {("b", "OK"), ("c", "ERROR")}
    assert artifacts.run_summary(cache=cache, questions=q) == {"cache": 1, "questions": 3}
    assert {(r.artifact, r.question_id) for r in artifacts.missing_by_artifact(q, 1, cache=cache, all=q).collect()} == {("cache", "b")}
    answers = lambda *rows: spark.createDataFrame(list(rows), "question_id string, answer string")
    up = {r.question_id: r.answer for r in artifacts.upsert_answers(q, answers(("a", "new")), answers(("a", "old"), ("b", "old"))).collect()}
    assert up == {"a": "new", "b": "old", "c": ""}


def reply(tool=None, args=None, status=200, **more):
    calls = [{"function": {"name": tool, "arguments": args}}] if tool else []
    return json.dumps({"custom_id": "i", "response": {"status_code": status, "body": {"choices": [{"message": {"tool_calls": calls}}]}}} | more)


def read(spark, make, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.x for r in sorted(df.select("k", make(F.col("v")).alias("x")).collect(), key=lambda r: r.k)]


def test_generation_and_extraction(spark):
    asked = [
        reply("format_answer", '{"answer": " A ", "reasoning": "r"}'), reply("format_answer", '{"reasoning": "r"}'), reply("format_answer", '{"answer": "a"}'), reply("format_answer", "{"),
        reply("format_answer", "[1]"), reply("other", "{}"), reply(status=500), reply("format_answer", "{}", error="boom"), '{"custom_id": "i", "response": {"status_code": 200, "body": {"choices": []}}}', reply("format_answer", " "),
    ]
    got = read(spark, batch.generation, asked)
    assert tuple(got[0]) == ("i", "A", "r", None) and (got[2].answer, got[2].error) == ("a", "missing required field: reasoning")
    assert [g.error for g in got] == [
        None, "missing required field: answer", "missing required field: reasoning", "invalid tool arguments JSON", "tool arguments must be a JSON object",
        "no format_answer tool call in response", "non_200_response", "line_error", "no_choices", "missing required field: answer",
    ]
    args = '{"entities": [{"surface": "A", "type": "ORG"}], "triples": [{"subject": "A", "predicate": "led", "object": "B", "confidence": 0.5}]}'
    t = read(spark, batch.extraction, [reply("extract_entities_and_triples", args), reply("extract_entities_and_triples", "{"), reply("x", "{}"), reply(status=404)])
    assert t[0].error is None and t[0].entities[0].surface == "A" and t[0].triples[0].predicate == "led"
    assert [x.error for x in t] == [None, "json_decode_error", "no_extract_tool_call", "non_200_response"]


def test_prompts_and_ids(spark):
    row = spark.createDataFrame([("who?", [("t1", ["p"]), ("t2 {question}", [])], ["A", " "], "run::x")], "q string, chunks array<struct<text:string,path_lines:array<string>>>, golds array<string>, r string")
    plain = row.select(batch.messages(F.col("q"), F.col("chunks"), F.lit("OK"), "C: {context} Q: {question}", "sys").alias("m")).first().m
    assert [tuple(x) for x in plain] == [("system", "sys"), ("user", "C: t1\n\n---\n\nt2 {question} Q: who?")]
    paths = row.select(batch.messages(F.col("q"), F.col("chunks"), F.lit("OK"), "Base", "sys", True).alias("m")).first().m
    assert paths[0].content == "Base" and "[p]\n\nt1" in paths[1].content and paths[1].content.startswith("Base\n\nContext:\n")
    assert row.select(batch.messages(F.col("q"), F.col("chunks"), F.lit("ERROR"), "{context}|{question}", "s").alias("m")).first().m[1].content == "|who?"
    m = batch.messages(F.col("q"), F.col("chunks"), F.lit("OK"), "{context}{question}", "s")
    body = json.loads(row.select(batch.completion_body(m, "model").alias("b")).first().b)
    assert body["tool_choice"]["function"]["name"] == "format_answer" and body["messages"][1]["role"] == "user" and len(row.select(batch.hash_messages(m).alias("h")).first().h) == 64
    ask = json.loads(row.select(batch.answerability_body(F.col("q"), F.col("golds"), F.lit(None).cast("string"), "{question}|{gold_answers}|{gold_support}", "model").alias("b")).first().b)
    assert ask["messages"][1]["content"] == "who?|- A|" and ask["response_format"]["json_schema"]["strict"] is True
    judge = json.loads(row.select(batch.judge_body(F.col("q"), F.array().cast("array<string>"), F.lit("p"), "{gold_answers}/{prediction}", "model").alias("b")).first().b)
    assert judge["messages"][0]["content"] == "(none)/p"
    line = row.select(batch.batch_line(batch.custom_id(F.lit("gen"), F.col("r"), F.lit(3)), batch.completion_body(m, "model")).alias("l")).first().l
    assert json.loads(line)["custom_id"] == "gen::run__x::3" and json.loads(line)["body"]["model"] == "model"
    assert row.select(batch.custom_id_parts(F.lit("gen::run__x::3")).alias("p")).first().p == ["gen", "run::x", "3"]
    assert [tuple(r) for r in row.select(batch.prefixed_id(F.lit("ans::a__b"), "ans"), batch.prefixed_id(F.lit("x::a"), "ans")).collect()] == [("a::b", None)]


def test_support_fields_and_states(spark):
    kind = "s array<string>, t array<string>, i array<int>, o array<struct<title:string,sent_id:int>>"
    rows = [(["a", "b"], [" T", None], [1, None], None), (["a"], ["x", "y"], None, [("old", 4)]), (["a"], None, None, None), (None, None, None, None)]
    got = [r.f for r in spark.createDataFrame(rows, kind).select(batch.support_fields(F.col("s"), F.col("t"), F.col("i"), F.col("o")).alias("f")).collect()]
    assert [[tuple(x) for x in f] for f in got] == [[("a", "T", 1), ("b", "", -1)], [("a", "old", 4)], [("a", "", -1)], []]
    states = spark.createDataFrame([("success", 0, True, "e"), ("failed", None, False, "e"), (None, None, True, None), (None, 2, None, "e")], "s string, a int, x boolean, e string")
    out = [tuple(r.z) for r in states.select(batch.extraction_state(F.col("s"), F.col("a"), F.col("x"), F.col("e")).alias("z")).collect()]
    assert out == [("success", 1, None), ("failed", 1, "e"), ("success", 1, None), ("pending", 2, "e")]
    p = spark.range(1).select(batch.pending(F.lit("failed"), F.lit("c"), F.array(F.lit("c"))), batch.pending(F.lit(None).cast("string"), F.lit("c"), F.array(F.lit("d"))), batch.pending(F.lit("success"), F.lit("c")))
    assert tuple(p.first()) == (True, False, False)


DICT = "match_key string, canonical string, df int, prio int"
ALIAS = "alias string, canonical string, pos string"


def test_entities(spark):
    words = spark.createDataFrame([("new york", "new york", 2, 3), ("york", "york", 1, 3), ("rare item", "rare item", 1, 2), ("common item", "common item", 50, 2), ("ate", "ate", 1, 3), ("who", "who", 1, 3), ("u.s.", "u.s.", 1, 1), ("the hunger games", "hunger games", 1, 3)], DICT)
    curated = spark.createDataFrame([("U.S.", "United States", "1"), ("York", "curated", "1")], ALIAS)
    kept = spark.createDataFrame([("york", "York City", "1")], ALIAS)
    alias = entities.aliases(kept, curated)
    assert {(r.alias, r.canonical) for r in alias.collect()} == {("u s", "united states"), ("york", "york city")}
    asked = spark.createDataFrame([(1, "I live in New  York today"), (2, "rare item or common item"), (3, "paternal line who"), (4, "The U.S. and york"), (5, "the Hunger Games"), (6, None)], "id int, text string")
    got = {}
    for r in sorted(entities.extract(asked, words, alias, max_df=5).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.id, []).append(r.canonical)
    assert got == {1: ["new york"], 2: ["rare item"], 4: ["york city", "united states"], 5: ["hunger games"]} or got[4] == ["united states", "york city"]
    soft = entities.extract(asked, words, alias, max_df=None).where("id = 2").collect()
    assert {(r.canonical, r.n_tokens, r.matched) for r in soft} == {("rare item", 2, "rare item"), ("common item", 2, "common item")}
    flags = spark.createDataFrame([("a",), ("us",), ("zz",), ("abc",), ("the same",), ("second",)], "k string").select(entities.spurious(F.col("k")).alias("x")).collect()
    assert [r.x for r in flags] == [True, False, True, False, True, True]


def test_aliases_titles_and_seeds(spark):
    red = spark.createDataFrame([("B page", "x"), ("A page", "x"), ("A page", None)], "title string, redirect string")
    assert {(r.alias, r.canonical) for r in entities.aliases(entities.redirect_aliases(red)).collect()} == {("x", "b page")}
    lex = spark.createDataFrame([("new york", ["NYC", "Big Apple"], "7", 1), ("new york", ["x"], "bad", 2)], "norm string, surface_forms array<string>, df string, pos int")
    assert {(r.alias, r.canonical) for r in entities.aliases(entities.lexicon_aliases(lex)).collect()} == {("nyc", "new york"), ("big apple", "new york"), ("x", "new york")}
    assert [(r.norm, r.df) for r in entities.df_map(lex).collect()] == [("new york", 0)]
    forms = spark.createDataFrame([("['a', 'b c']",), ("plain",), ("",), (None,), ("[broken",)], "r string").select(entities.surface_forms(F.col("r")).alias("f")).collect()
    assert [r.f for r in forms] == [["a", "b c"], ["plain"], [], [], ["[broken"]]
    assert spark.range(1).select(entities.capitalised(F.lit("When did Ann Lee meet Bob and Ann Lee")).alias("c")).first().c == ["When", "Ann Lee", "Bob"]
    t = entities.title_matches(spark.createDataFrame([(1, "the rivers of Old Town and old"), (2, None)], "id int, text string"), spark.createDataFrame([("Old Town",), ("Old",), ("River",)], "title string"))
    assert {(r.id, r.title) for r in t.collect()} == {(1, "Old Town"), (1, "Old")}
    c = spark.createDataFrame([("q", "known"), ("q", "near"), ("q", "gone")], "question_id string, canonical string")
    near = spark.createDataFrame([("near", "absent", 0.9), ("near", "there", 0.8), ("known", "there", 0.7)], "canonical string, matched string, score double")
    got = {(r.canonical, r.node, r.vector_score, r.graph_present) for r in entities.enrich_seeds(c, spark.createDataFrame([("known",), ("there",)], "entity string"), near).collect()}
    assert got == {("known", "known", None, True), ("there", "there", 0.8, True), ("gone", None, None, False)}
    assert entities.fingerprint(c) == entities.fingerprint(c.orderBy(F.desc("canonical"))) != entities.fingerprint(near)


def test_alignment(spark):
    chunks = spark.createDataFrame([("T", 0, "Hello world. Hello world."), ("T", 1, "hello  WORLD. Second sentence."), (" ", 0, "x"), ("U", 0, "Moved to Rome in 1901.")], "title string, pos int, text string")
    cand = alignment.title_sentences(chunks)
    assert sorted(r.sentence for r in cand.where("title = 'T'").collect()) == ["Hello world.", "Second sentence."]
    anchors = spark.createDataFrame([(1, "T", "hello world."), (2, "U", "He moved to Rome in 1901."), (3, "U", "Nothing alike at all."), (4, "X", "no title")], "anchor_id int, title string, sentence string")
    vec = spark.createDataFrame([("He moved to Rome in 1901.", [1.0, 0.1]), ("Moved to Rome in 1901.", [1.0, 0.0]), ("Nothing alike at all.", [0.0, 1.0])], "sentence string, vec array<double>")
    out = {r.anchor_id: r for r in alignment.align(anchors, cand, vec).collect()}
    assert {k: r.reason for k, r in out.items()} == {1: "already_present", 2: "aligned", 3: "below_thresholds", 4: "no_corpus_chunks_for_title"}
    assert out[2].replacement == "Moved to Rome in 1901." and math.isclose(out[2].rouge_l, 10 / 11) and out[1].semantic_cosine == 1.0
    assert out[3].nearest_candidate == "Moved to Rome in 1901." and out[3].replacement is None and out[4].rouge_l == 0.0
    items = spark.createDataFrame([("q", 0, "a"), ("q", 1, "b"), ("p", 0, "c")], "question_id string, pos int, sentence string")
    d = spark.createDataFrame([("q", 0, "A", "aligned"), ("q", 1, None, "already_present"), ("p", 0, None, "below_thresholds")], "question_id string, pos int, replacement string, reason string")
    got = {r.question_id: (r.gold_support_sentences, r.resolved) for r in alignment.rewritten(items, d).collect()}
    assert got == {"q": (["A", "b"], True), "p": (["c"], False)}


def test_comparisons(spark):
    hits = spark.createDataFrame([("q", f"c{k}", 1.0 - k / 10, k) for k in range(4)], "question_id string, chunk_id string, score double, rank int")
    new = spark.createDataFrame([("q", "c0", 0.1), ("q", "c1", 0.5), ("q", "c2", 0.5)], "question_id string, chunk_id string, new_score double")
    got = compare.rerank(hits, new, 3).collect()
    assert [(r.chunk_id, r["rank"], r.old_score) for r in sorted(got, key=lambda r: r["rank"])] == [("c1", 0, 0.9), ("c2", 1, 0.8), ("c0", 2, 1.0)]
    assert compare.rerank(hits, None, 2).count() == 2
    q = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "question_id string")
    run = lambda *rows: spark.createDataFrame(list(rows), "question_id string, ndcg double, f1 double, chunk_ids array<string>")
    a, b = run(("a", 0.1, 0.5, ["x"]), ("b", 0.5, 0.5, ["x"])), run(("a", 0.9, 0.5, ["x", "y"]), ("b", 0.6, 0.9, []), ("c", 1.0, 0.0, ["z"]))
    out = compare.interesting(q, a, b, 0.1, 0.0).collect()
    assert [(r.question_id, r.overlap) for r in out] == [("c", 0.0), ("a", 0.5)]
    only = q.where("question_id <> 'd'")
    assert compare.skipped(q, only, a=a, b=b).first().asDict() == {"joined": 3, "missing_a": 1, "missing_b": 0, "restricted": 1}
    shown = spark.createDataFrame([([(0, "c", 0.5, "abcdef")],)], "c array<struct<rank:int,chunk_id:string,score:double,text:string>>").select(compare.preview(F.col("c"), 3, 3).alias("p"), compare.preview(F.col("c"), 3, 0).alias("w")).first()
    assert shown.p[0].text_preview == "abc…" and shown.w[0].text_preview == "abcdef"
    ev = compare.evaluated(q, a.select("question_id", F.lit("OK").alias("status")), spark.createDataFrame([("z", "p")], "question_id string, prediction string")).collect()
    assert {(r.question_id, r.status, r.prediction) for r in ev} == {("a", "OK", ""), ("b", "OK", ""), ("c", "EMPTY", ""), ("d", "EMPTY", ""), ("z", "EMPTY", "p")}
    dec = spark.createDataFrame([("q", 1.0, True, False)], "question_id string, dense_weight double, run_dense boolean, run_graph boolean")
    full, top = compare.routed(hits.drop("rank"), hits.drop("rank"), dec, 3, 2)
    assert [r.chunk_id for r in full.orderBy("rank").collect()] == ["c0", "c1", "c2"] and top.count() == 2


def test_bootstrap(spark):
    rows = [("a", float(k % 10), k) for k in range(500)] + [("b", 3.0, 0), ("c", None, 0), ("d", float("nan"), 0), (None, 1.0, 1), (None, 1.0, 2)]
    df = spark.createDataFrame(rows, "g string, v double, id long")
    out = {r.g: r for r in compare.bootstrap(df, "g", "v", "id", 2000).collect()}
    again = {r.g: r for r in compare.bootstrap(df.orderBy("v").repartition(7), "g", "v", "id", 2000).collect()}
    assert all(math.isclose(x, y) for g in out for x, y in zip(out[g][2:], again[g][2:], strict=True)) and set(again) == set(out)
    assert compare.bootstrap(df.limit(0), "g", "v", "id", 20).collect() == []
    assert (out[None].n, out[None].low, out[None].high) == (2, 1.0, 1.0)
    assert set(out) == {"a", "b", None} and (out["b"].low, out["b"].high) == (3.0, 3.0) and math.isclose(out["a"].mean, 4.5)
    half = 1.96 * (8.25 / 500) ** 0.5
    assert abs(out["a"].low - (4.5 - half)) < 0.03 and abs(out["a"].high - (4.5 + half)) < 0.03


def test_figures(spark):
    grid = [0.0, 0.25, 0.5, 0.75, 1.0]
    curves = {"z": [0.0] * 5, "o": [1.0] * 5, "m": [0.1, 0.3, 0.9, 0.9, 0.2], "e": [1.0, 0.0, 0.0, 0.0, 1.0]}
    df = spark.createDataFrame([(k, "test", c, grid, 0.6) for k, c in curves.items()], "question_id string, split string, oracle_curve array<double>, weight_grid array<double>, predicted_weight double")
    assert [r.question_id for r in compare.figure("benchmark_oracle_heatmap", df).collect()] == ["e", "m"]
    assert [r.question_id for r in compare.curve_heatmap(df, "test", interior=True).collect()] == ["m"] and compare.curve_heatmap(df, "dev").count() == 0
    got = {r.question_id: (r.distance, r.hit) for r in compare.prediction_scatter(df).collect()}
    assert got["m"] == (0.0, True) and got["e"] == (0.4, False)
    s = compare.prediction_summary(df).first()
    assert (s.n, s.hit_share) == (4, 0.75) and math.isclose(s.mae, 0.1)
    assert [r.question_id for r in compare.prediction_intervals(df).collect()] == ["e", "o", "z", "m"]
    weights = {r.weight: (r.single, r.tied) for r in compare.best_weights(df).collect()}
    assert weights[0.0] == (0, 3) and weights[0.5] == (0, 3)
    assert set(compare.figures(df, [{"kind": "router_pred_vs_oracle"}, {"kind": "benchmark_oracle_heatmap", "name": "h", "split": "test"}])) == {"router_pred_vs_oracle", "h"}
    with pytest.raises(ValueError):
        compare.figure("pie", df)
