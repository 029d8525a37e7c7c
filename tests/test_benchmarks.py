"""Loaders of question benchmarks, article cleaning and chunking."""

import hashlib
import json
import time

import pytest
from pyspark.sql import functions as F

from fusemill.functions import articles
from fusemill.sources import benchmarks

HOBBIT = "The Hobbit is a novel by Tolkien ."


def nq(question, tokens, answers, html=None, title="The Hobbit", **more):
    toks = tokens.split()
    doc = {"title": title, "html": html if html is not None else f"<html><body><p>{tokens.replace(' .', '.')}</p></body></html>", "tokens": {"token": toks, "is_html": [False] * len(toks)}}
    return {"question": {"text": question}, "document": doc, "annotations": [{"short_answers": answers}], **more}


def loaded(spark, tmp_path, rows, load, suffix=".jsonl", **options):
    path = f"{tmp_path}/raw{suffix}"
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n\n".join(json.dumps(r) for r in rows) if suffix == ".jsonl" else json.dumps(rows))
    return load(benchmarks.read_variants(spark, path), **options).collect()


def test_nq(spark, tmp_path):
    rows = [
        nq("Who wrote The Hobbit?", HOBBIT, [{"text": ["Tolkien"], "start_token": [6], "end_token": [6]}]),
        nq("from the span", HOBBIT, [{"text": [], "start_token": 6, "end_token": 6}]),
        nq("who founded google", "Google was founded by Page and Brin .", [{"text": ["Page"], "start_token": [4], "end_token": [4]}, {"text": ["Brin"], "start_token": [6], "end_token": [6]}], title="Google"),
        nq("no sentence holds it", HOBBIT, [{"text": [], "start_token": 6, "end_token": 6}], html="<p>Something else altogether.</p>"),
        nq("no answer", HOBBIT, []),
        {"question": "no document", "annotations": {"short_answers": {"text": "x", "start_token": 0, "end_token": 0}}},
        {"annotations": []},
    ]
    rows[0]["annotations"] = rows[0]["annotations"][0]  # one annotation in place of a list
    out = {r.question: r for r in loaded(spark, tmp_path, rows, benchmarks.load_nq, version="v1")}
    assert set(out) == {"Who wrote The Hobbit?", "from the span", "who founded google"}
    first = out["Who wrote The Hobbit?"]
    assert first.gold_answers == ["Tolkien"] and first.gold_support_sentences == ["The Hobbit is a novel by Tolkien."]
    assert first.gold_support_titles == ["The Hobbit"] and first.gold_support_sent_ids == [-1] and first.dataset_version == "v1"
    assert first.question_id == hashlib.sha256(first.question.encode()).hexdigest()
    assert out["from the span"].gold_answers == ["Tolkien"]
    assert out["who founded google"].gold_answers == ["Page", "Brin"] and len(out["who founded google"].gold_support_sentences) == 1
    reasons = {r.question: r.fail_reasons for r in loaded(spark, tmp_path, rows, benchmarks.nq_parsed)}
    assert reasons["Who wrote The Hobbit?"] == [] and reasons["no answer"] == ["missing short answers"]
    assert reasons["no document"] == ["missing document context"] and len(reasons[None]) == 3


def test_nq_long_sentence_is_trimmed():
    tail = "the red harbour town was built by Ann Lee in a single summer"
    long = "x " * 130 + tail
    assert benchmarks.trimmed(long, ["Ann Lee"], "who built the red harbour town") == "harbour town was built by Ann Lee in a single summer"
    assert benchmarks.trimmed("short Ann Lee", ["Ann Lee"], "red harbour") == "short Ann Lee"
    assert benchmarks.trimmed(long, ["nobody"], "red harbour") == long
    assert benchmarks.question_phrases("Who is the king of the old hill and the old hill") == ["who king", "king old", "old hill", "hill old"]
    assert benchmarks.context_terms(["The", "<b>", "Big", "cat,", "x"], [False, True, False, False, False], 2, 2, 1) == {"big", "cat"}


def hop(question, facts, answer="yes"):
    titles, bodies = ["A", "B", "A"], [["a zero. ", "a one."], ["b zero."], ["other zero.", "other one.", "other two."]]
    return {"question": question, "answer": answer, "context": {"title": titles, "sentences": bodies}, "supporting_facts": {"title": [t for t, _ in facts], "sent_id": [i for _, i in facts]}}


def test_multihop(spark, tmp_path):
    rows = [hop(" q one ", [("A", 0), ("A", 0), ("B", 0), ("A", 2), ("A", 9), ("C", 0), ("B", -1)]), hop("no fact", [("C", 0)]), hop("", [("A", 0)]), hop("many", [("A", 1)], ["x", " y "]), {"question": "bare", "answer": "x"}]
    for suffix in (".jsonl", ".json"):
        out = {r.question: r for r in loaded(spark, tmp_path, rows, benchmarks.load_multihop, suffix, source="hotpotqa")}
        assert set(out) == {"q one", "many"}
        one = out["q one"]
        assert one.gold_support_sentences == ["a zero.", "b zero.", "other two."] and one.gold_support_titles == ["A", "B", "A"] and one.gold_support_sent_ids == [0, 0, 2]
        assert out["many"].gold_answers == ["x", "y"]
    kept = loaded(spark, tmp_path, {"data": rows}, benchmarks.load_multihop, ".json", source="2wiki", strip_question=False)
    assert {r.question for r in kept} == {" q one ", "many"}
    with pytest.raises(ValueError):
        benchmarks.read_variants(spark, "x.csv")


def test_multihop_reads_the_context_once(spark, tmp_path):
    """A record of many facts: time goes with facts times articles at most, not with a new reading of the context for each fact and each line found."""
    n = 150
    record = {"question": "q", "answer": "x", "context": {"title": [f"T{k}" for k in range(n)], "sentences": [["no", f"said {k}"] for k in range(n)]}, "supporting_facts": {"title": [f"T{k}" for k in range(n)], "sent_id": [1] * n}}
    began = time.time()
    (row,) = loaded(spark, tmp_path, [record], benchmarks.load_multihop, source="2wiki")
    assert row.gold_support_sentences == [f"said {k}" for k in range(n)] and row.gold_support_titles[-1] == f"T{n - 1}"
    assert time.time() - began < 15


def test_samples_and_paths(spark, tmp_path):
    rows = [hop("q one", [("A", 0)]), {"question": "q two", "answer": "x"}, {"question": "q three"}]
    path = f"{tmp_path}/r.jsonl"
    with open(path, "w") as f:
        f.write("\n".join(map(json.dumps, rows)))
    raw = benchmarks.read_variants(spark, path)
    items = spark.createDataFrame([(s, hashlib.sha256(q.encode()).hexdigest()) for s in ("nq", "2wiki") for q in ("q one", "q two")], "dataset_source string, question_id string")
    both = raw.withColumn("dataset_source", F.lit("nq")).union(raw.withColumn("dataset_source", F.lit("2wiki"))).select("dataset_source", "v")
    got = benchmarks.samples(both, items).select("dataset_source", benchmarks.nq_question(F.col("v")).alias("q")).collect()
    assert sorted(map(tuple, got)) == [("2wiki", "q one"), ("nq", "q one"), ("nq", "q two")]
    assert sorted(map(tuple, benchmarks.raw_paths(items, {"nq": "/x"}).collect()), key=str) == [("2wiki", None), ("nq", "/x")]
    need = spark.createDataFrame([([" A", "B", "A", ""],), (["C"],)], "titles array<string>")
    there, gone = benchmarks.supporting_articles(need, spark.createDataFrame([("A", "x"), ("D", "y")], "title string, html string"))
    assert [tuple(r) for r in there.collect()] == [("A", "x")] and sorted(r.title for r in gone.collect()) == ["B", "C"]
    keys = spark.createDataFrame([("h", "t", 1), (" ", "t", 2), (None, None, 3)], "h string, t string, i int").select(benchmarks.article_key(F.col("h"), F.col("t"), F.col("i")).alias("k")).collect()
    assert [r.k for r in keys] == [hashlib.sha256(x.encode()).hexdigest() for x in ("h", "t", "3")]


PAGE = """<html><body><nav>Menu</nav><div class="mw-parser-output"><p>Lead <b>text</b><sup class="reference">[1]</sup> here.</p><table><tr><td>cell</td></tr></table>
<div class="navbox"><p>box</p></div><h2>Life<span class="mw-editsection">edit</span></h2><p>Born in <a title="Help:IPA/x">ipa</a>1900.<h3>Youth</h3><ul><li>one<li>two<ol><li>deep</ol></ul>
<h2>Work</h2><p></p><ul></ul><script>var p = "</p>"</script></div><p>outside</p></body></html>"""


def test_cleaning(spark):
    got = articles.blocks_of(PAGE)
    assert [(b.text, b.section_path, b.block_type) for b in got] == [
        ("Lead text here.", ["Lead"], "paragraph"),
        ("Life", ["Lead", "Life"], "paragraph"),
        ("Born in 1900.", ["Lead", "Life"], "paragraph"),
        ("Youth", ["Lead", "Life", "Youth"], "paragraph"),
        ("- one\n- two deep", ["Lead", "Life", "Youth"], "list"),
        ("- deep", ["Lead", "Life", "Youth"], "list"),
        ("Work", ["Lead", "Work"], "paragraph"),
    ]
    assert articles.blocks_of(None) == articles.blocks_of("") == [] and articles.blocks_of("<p>a<p>b")[1].text == "b"
    rows = spark.createDataFrame([(1, PAGE), (2, None)], "id int, html string").select("id", articles.blocks(F.col("html")).alias("b")).collect()
    assert {r.id: len(r.b) for r in rows} == {1: 7, 2: 0}
    assert articles.section_below(["Lead", "A", "B"], "C", "h2") == ["Lead", "C"] and articles.section_below(["Lead"], "T", "h1") == ["Lead", "T"]


WORDS = articles.Encoder(lambda t: [int(w[1:]) for w in t.split()], lambda ids: " ".join(f"w{i}" for i in ids))


def block(a, b):
    return articles.Block(" ".join(f"w{i}" for i in range(a, b)), ["S"], "paragraph")


def test_chunking():
    sizes = lambda parts, **o: [p.n_tokens for p in articles.chunked(parts, WORDS, **o)]
    assert sizes([block(0, 3), block(3, 6)], most=10, overlap=2) == [6]
    out = articles.chunked([block(0, 6), block(6, 12)], WORDS, most=10, overlap=2)
    assert [p.text.split() for p in out] == [[f"w{i}" for i in range(6)], ["w4", "w5", *[f"w{i}" for i in range(6, 12)]]]
    assert out[1].start == out[0].end and out[1].end - out[1].start == len(out[1].text)
    assert sizes([block(0, 25)], most=10, overlap=4) == [10, 10, 10, 7, 1]  # windows of a long block
    assert sizes([block(0, 6), block(6, 15)], most=10, overlap=2) == [6, 9]  # the overlap leaves no room and goes
    assert sizes([block(0, 6), articles.Block(" ", [], "paragraph")], most=10, overlap=2) == [6] and sizes([]) == []
    assert WORDS.tail("w1 w2 w3", 2) == "w2 w3" and WORDS.tail("", 2) == "" and WORDS.tail("w1", 5) == "w1"


def test_chunks_of_a_table(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([("d", PAGE), ("e", None)], "doc_key string, html string").withColumn("blocks", articles.blocks(F.col("html")))
    out = articles.chunks(df, path, most=12, overlap=2).orderBy("idx").collect()
    assert len(out) > 1 and all(r.doc_key == "d" for r in out)
    assert out[0].chunk_id == hashlib.sha256(f"d:0:{out[0].text}".encode()).hexdigest()
    counts = df.select(articles.token_count(F.lit("a b"), path).alias("n")).collect()
    assert [r.n for r in counts] == [2, 2]
