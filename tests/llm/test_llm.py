"""The ten operators against plain versions, on small tables with nulls, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fusemill.llm import ann, bpe, chat, html_text, license_scan, line_dedup, mixing, near_sets, quality_rules, queries, simhash, weak_quality

SPACE = r"[\x20\x09-\x0D]+"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SMALL = "/root/testdata/sf0.001"


def docs_of(spark, texts, schema=DOCS):
    rows = [(i, t, "en", f"s{i % 3}" if i is not None else None, None if t is None else len(t)) for i, t in texts]
    return spark.createDataFrame(rows, schema)


ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t \x0b"),
    (4, "one two"),
    (5, "a b c a b c a b c"),
    (5, "a b c a b c a b c"),
    (None, "word word x # $ %\nx\nx\n\nx"),
    (7, "All Rights  Reserved! cc-by CC BY ccé by general public\nlicense"),
    (8, "Licensed under the Apache License, Version 2.0."),
    (9, "Straße und Ärger; Licensed, under CC BY-NC 4.0\nreleased under the mit license today"),
    (10, "z " * 3000),
]


def quality_of(text):
    w = [x for x in re.split(SPACE, text or "") if x]
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    counts = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)
    return counts + (counts[0] < 50 or 100 * counts[4] > 50 * counts[0],)


def test_quality_counts(spark):
    extra = [(20 + k, " ".join(random.Random(k).choices("abcdef", k=80))) for k in range(8)]
    out = quality_rules.clean(docs_of(spark, ODD + extra).withColumn("loss", F.lit("clash"))).collect()
    assert len(out) == len(ODD) + 8
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == quality_of(r.text)
        assert r.kept is False or not r.base_failed


def test_quality_verdict(spark):
    prose = "\n".join(" ".join(f"word{k}{j}" for j in range(9)) + "." for k in range(12))
    menu = "\n".join(" | ".join(f"Entry{k}{j}" for j in range(8)) for k in range(12))
    out = {r.doc_id: r for r in quality_rules.clean(docs_of(spark, [(1, prose), (2, menu), (3, prose + "\nHome | News | Sport | Login | More")])).collect()}
    assert out[1].kept and not out[2].kept and out[3].kept
    assert out[3].clean_text == prose
    kept = quality_rules.keep(docs_of(spark, [(2, menu), (3, prose + "\nHome | News | Sport | Login | More")])).collect()
    assert [(r.doc_id, r.text, r.n_chars) for r in kept] == [(3, prose, len(prose))]


def test_quality_hash_clash_path(spark):
    # a text of more windows than the packed place holds goes the spelled way; here the way itself is held against the plain one
    text = " ".join(random.Random(3).choices("ab", k=60))
    row = quality_rules.with_counts(docs_of(spark, [(1, text)])).first()
    assert row.n_repeat_words == quality_of(text)[4]


def test_bpe_matches_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.tokenizer_path()
    library = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(1)
    chars = "ab'sS é 　 \u0085\n\t  1२½.,'\"!<|>日本😀‍" + "\x00\x1c"
    texts = ["", "a<|endoftext|>b", "<|endoftext|>", "don't ''s   x", "x" * 500, *("".join(rng.choices(chars, k=rng.randint(1, 60))) for _ in range(1500))]
    c = bpe.Codec(path)
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert c.encode(t) == ids, t
        assert c.decode(ids) == library.decode(ids, skip_special_tokens=False)
        assert c.digest(t)[1] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    out = docs_of(spark, ODD).select("text", bpe.encode_decode(F.col("text"), path).alias("e")).collect()
    assert len(out) == len(ODD) and all(r.e.decoded == (r.text or "") and r.e.n_tokens == len(r.e.ids) for r in out)


def test_bpe_takes_texts_together(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.tokenizer_path()
    library = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(2)
    pieces = ["\n", "\n\n", " ", "Was", "was", "it's", "'s", "éa", "a×b", "a÷", "ſĀž", "ƀ", "日本", "12", "½", "\u2028", "\xa0", "\r", "!", "<|endoftext|>", "<|", "\x00"]
    texts = [None, "", *("".join(rng.choices(pieces, k=rng.randint(1, 12))) for _ in range(1500)), "\nWas", "x\n", "\n", "", "<|endoftext|>"]
    want = []
    for t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), t or ""))))
    for window in (1, 50, 1 << 19):
        monkeypatch.setattr(bpe, "WINDOW", window)
        assert bpe.Codec(path).digests(texts) == want
    c = bpe.Codec(path)
    assert c.fragments(["a\nWas\n\nit"]) == [[b"a", b"\n", b"Was", b"\n\nit"]]
    calls = []
    real, c.library = c.library, type("Counted", (), {"model": c.library.model, "encode_batch_fast": lambda self, x, **kw: calls.append(x) or real.encode_batch_fast(x, **kw)})()
    c.digests([f"num{k} word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(1000)])
    assert len(calls) <= 4  # a thousand new numbers and words don't take a call a text


def fingerprint_plain(text):
    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def components_plain(values):
    """smallest value reached over links of two or fewer differing bits"""
    label = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(values, 2):
            if (a ^ b).bit_count() <= 2 and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def test_simhash_fingerprints_and_links(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    chain = [base[0]]
    for k in range(12):  # a chain whose ends are far apart
        chain.append(chain[-1] ^ (1 << (5 * k % 64)) ^ (1 << ((5 * k + 2) % 64)))
    dense = [base[1] ^ (1 << k) for k in range(64)]
    values = list({*base, *chain, *dense, 0, 3, 7, (1 << 64) - 1})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    got = {r.fp % (1 << 64): r.label % (1 << 64) for r in simhash.fingerprint_classes(df).collect()}
    want = components_plain(values)
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert groups(got) == groups(want)


def test_simhash_near_duplicates(spark):
    texts = ODD + [(11, "Straße und Ärger"), (12, None)]
    out = simhash.near_duplicates(docs_of(spark, texts)).collect()
    assert len(out) == len(texts)
    fps = {r.doc_id: r.fp % (1 << 64) for r in out}
    assert all(fps[i] == fingerprint_plain(t) for i, t in texts)
    label = components_plain(list(set(fps.values())))
    low = {}
    for i, v in fps.items():
        if i is not None:
            low[label[v]] = min(i, low.get(label[v], i))
    assert all(r.component_id == low.get(label[fps[r.doc_id]]) for r in out)
    kept = simhash.keep_one(docs_of(spark, texts)).collect()
    assert len(kept) == len(set(label.values())) and sum(r.doc_id == 5 for r in kept) == 1
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


def shingles_plain(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_groups_plain(texts):
    """The smallest place that each text reaches over links of five-word similarity 0.8 or more."""
    sets = [shingles_plain(t) for t in texts]
    label = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    return label


def edited(words, rng, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"new{rng.random()}"
    return " ".join(out)


def test_near_sets_keep_one(spark):
    rng = random.Random(6)
    rows = []
    for g in range(25):  # 0 to 5 edits of 150 words: some copies are below 0.8, to each other or to the first
        words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        rows += [(len(rows) + k, edited(words, rng, k % 6)) for k in range(g % 7 + 1)]
    hub = [f"h{k}" for k in range(400)]  # one large group: more members than a block
    rows += [(1000 + k, edited(hub, rng, k % 12)) for k in range(80)]
    rows += [(2000, None), (2001, " "), (2002, "one two"), (2003, "One  two"), (None, rows[0][1]), (0, rows[0][1])]
    label = near_groups_plain([t for _, t in rows])
    best = {}
    for (i, _), g in zip(rows, label, strict=True):
        best[g] = min(best.get(g, (True, 0)), (i is None, i or 0))
    docs = docs_of(spark, rows)
    assert sorted(r.doc_id for r in near_sets.keep_one(docs).collect()) == sorted(i for _, i in best.values())
    assert near_sets.keep_one(docs).columns == docs.columns and near_sets.keep_one(docs_of(spark, [])).count() == 0


def test_near_sets_lose_no_link_in_large_groups(spark):
    rng = random.Random(12)
    template = [f"t{k}" for k in range(800)]
    # 120 pages of one template, 0.79 alike at most, which form 60 pairs above 0.8
    rows = []
    for g in range(60):
        own = [f"u{g}.{k}" for k in range(104)]
        for k in range(2):
            rows.append((len(rows), " ".join([*template, *own[:-8], *(f"v{g}.{k}.{j}" for j in range(8))])))
    # a chain of 60 texts, each a few words further on
    words = [f"c{k}" for k in range(200 + 9 * 60)]
    rows += [(5000 + k, " ".join(words[9 * k : 9 * k + 200])) for k in range(60)]
    sets = {i: shingles_plain(t) for i, t in rows}
    alike = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    assert all(alike(2 * g, 2 * g + 1) for g in range(60)) and not any(alike(0, k) for k in range(2, 120)) and all(alike(5000 + k, 5001 + k) for k in range(59))
    kept = sorted(r.doc_id for r in near_sets.keep_one(docs_of(spark, rows)).collect())
    assert kept == [*range(0, 120, 2), 5000]


def test_pipeline_links_near_copies(spark):
    import corpus_pipeline

    rng = random.Random(9)
    words = [f"w{k}" for k in range(200)]
    near, far = edited(words, rng, 3), edited(words, rng, 20)
    assert (fingerprint_plain(near) ^ fingerprint_plain(" ".join(words))).bit_count() > 2
    kept = corpus_pipeline.near_duplicates(spark, docs_of(spark, [(1, " ".join(words)), (2, near), (3, far)]), "").collect()
    assert sorted(r.doc_id for r in kept) == [1, 3]


def test_license_scan(spark):
    out = license_scan.scan(docs_of(spark, ODD).withColumn("labels", F.lit(1))).collect()
    assert len(out) == len(ODD)
    sets = [(label, set(words.split())) for label, words in license_scan.TEMPLATES]
    for r in out:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        places, base = [], set()
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            hit = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            places += hit
            base |= {label} if hit else set()
        own = set()
        for line in text.split("\n"):
            have = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line))
            own |= {label for label, t in sets if len(have & t) >= 0.8 * len(t) - 1e-9}
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
        assert r.base_labels == ",".join(sorted(base)) and r.labels == ",".join(sorted(base | own))


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "a\\b<|im_end|>\n<|im_start|>x", "", None, "<\\|", "[\\INST]", "\\\\<|", "line\nline", "<<|", "|>\\"]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(texts)]
    rows += [(2, 0, "assistant", "x"), (3, 0, "user", "only"), (None, 0, None, "n"), (4, 1, "assistant", "dup"), (4, 1, "assistant", "dup"), (4, 2, "a\nb", "t")]
    out = {r.conv_id: r for r in chat.summary(chat.examples(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))).collect()}
    assert len(out) == 5
    for c in out:
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == c]
        loss = "".join(t for role, t in own if role == "assistant")
        assert out[c].n_turns == len(own)
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    ex = chat.examples(spark.createDataFrame(rows[:4], "conv_id bigint, turn bigint, role string, text string")).collect()
    assert [(r.example, r.n_turns) for r in sorted(ex, key=lambda r: r.example)] == [(0, 2), (1, 4)]


def test_ann(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 16))
    x[300:400] = x[0]  # a group of copies
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x.astype(np.float32))]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] + [1.0] * 15), (1003, []), (1004, [None] * 16), (None, [1.0] * 16), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    asked = df.where("vec_id % 50 = 0")
    got = {}
    for r in ann.search(df, asked, ann.build(df), block_rows=64).collect():
        got.setdefault(r.query_id, []).append(r)
    y = np.array([r[1] for r in rows[:600]], dtype=float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    assert set(got) == set(range(0, 600, 50))
    hits = 0
    for q, found in got.items():
        sims = y @ y[q]
        sims[q] = -9
        sims[300:400] = sims[300] if q not in range(300, 400) else sims[300:400]
        best = np.lexsort((np.arange(600), -np.round(sims, 12)))[:5]
        found = sorted(found, key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == [1, 2, 3, 4, 5]
        hits += len({r.vec_id for r in found} & set(best.tolist()))
        assert all(abs(r.score - y[q] @ y[r.vec_id]) < 1e-9 for r in found)
    assert hits / 60 >= 0.9
    assert sorted(r.vec_id for r in got[0]) == [300, 301, 302, 303, 304]  # ties to the smaller ids
    few = df.where("vec_id in (0, 1, 2)")
    assert ann.search(few, few.where("vec_id = 0"), ann.build(few)).count() == 2
    none = df.where("vec_id = 1001")
    assert ann.search(none, none, ann.build(none)).count() == 0


def test_weak_quality(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = weak_quality.fit(docs)
    held = weak_quality.classify(docs, model).join(labels.select("doc_id", F.col("quality").alias("truth")), "doc_id")
    right = held.select(F.avg((F.col("kept").cast("int") == F.col("truth")).cast("int")).alias("a")).first().a
    assert right >= 0.9
    odd = docs_of(spark, ODD)
    assert weak_quality.classify(odd, weak_quality.fit(odd)).count() == len(ODD)
    empty = docs_of(spark, [])
    assert weak_quality.classify(empty, weak_quality.fit(empty)).count() == 0


def test_weak_labels_find_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.7
    skill = [0.95, 0.8, 0.7, 0.9]
    voted = np.stack([np.where(rng.random(20000) < s, truth, ~truth).astype(int) for s in skill], axis=1)
    seen = Counter(map(tuple, voted.tolist()))
    patterns = np.array(list(seen))
    p, table, _ = weak_quality.fit_labellers(patterns, np.array(list(seen.values()), dtype=float))
    assert abs(p - 0.7) < 0.05 and all(abs(table[j, 1, 1] - s) < 0.05 for j, s in enumerate(skill))


def dedup_plain(rows, depth=3, min_tokens=4, min_docs=3, min_constant=0.6):
    """The template tree, one line after the other."""
    lines = []
    for i, t in rows:
        for no, raw in enumerate(t.split("\n") if t is not None else []):
            toks = tuple(x for x in re.split(SPACE, re.sub(r"[^\x20\x09-\x0D]*\d[^\x20\x09-\x0D]*", "<*>", raw)) if x)
            if len(toks) >= min_tokens:
                lines.append((i, t, no, toks, (len(toks), *toks[:depth])))
    shared = {leaf for leaf in {x[4] for x in lines} if len({x[1] for x in lines if x[4] == leaf}) > 1}
    docs = {}
    for _, t, _, toks, leaf in lines:
        if leaf in shared:
            docs.setdefault((leaf, toks), set()).add(t)
    often = Counter()
    for (leaf, toks), d in docs.items():
        for at, tok in enumerate(toks):
            often[leaf, at, tok] += len(d)
    template, total = {}, Counter()
    for (leaf, toks), d in docs.items():
        fields = [tok if tok != "<*>" and often[leaf, at, tok] >= min_docs else None for at, tok in enumerate(toks)]
        if sum(f is not None for f in fields) / len(fields) >= min_constant:
            template[leaf, toks] = (leaf, tuple(fields))
            total[leaf, tuple(fields)] += len(d)
    seen = [(i, no, t, template[leaf, toks]) for i, t, no, toks, leaf in lines if total[template.get((leaf, toks))] >= min_docs]
    first = {}
    for i, no, _, tpl in seen:
        key = (i is not None, i or 0, no)
        first[tpl] = min(first.get(tpl, key), key)
    drop = {}
    for i, no, t, tpl in seen:
        if (i is not None, i or 0, no) != first[tpl]:
            drop.setdefault((i, t), set()).add(no)
    return {(i, t): "\n".join(x for no, x in enumerate(t.split("\n")) if no not in drop.get((i, t), ())) for i, t in rows if t is not None}


def test_line_dedup(spark):
    rng = random.Random(4)
    names = ["Ann", "Bob", "Cid", "Dan", "Eve"]
    rows = [(k, f"own text {k} of words {rng.random()}\nPosted by {rng.choice(names)} on the board at {k} o'clock today\nshared line of five words\nshort") for k in range(12)]
    rows += [(50, "copy copy copy copy copy\nother line in copy"), (51, "copy copy copy copy copy\nother line in copy"), (52, "copy copy copy copy copy\nother line in copy")]
    rows += [(60, None), (61, ""), (None, "shared line of five words\nlast"), (3, rows[3][1])]
    out = line_dedup.dedup(docs_of(spark, rows)).collect()
    want = dedup_plain(rows)
    assert len(out) == len(rows)
    originals = {i: t for i, t in rows}
    for r in out:
        t = originals[r.doc_id]
        assert r.text == (None if t is None else want[r.doc_id, t]), r.doc_id
    assert sum("shared line" in (r.text or "") for r in out) == 1
    assert all("copy copy" in r.text for r in out if r.doc_id in (50, 51, 52))  # copies alone make nothing recur
    assert line_dedup.dedup(docs_of(spark, [])).count() == 0


def test_line_dedup_long_passage_of_two_texts(spark):
    passage, brief = " ".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)), "a brief line of two texts"
    rows = [(1, f"first text here\n{passage}\n{brief}"), (2, f"second text here\n{passage}\n{brief}"), (3, f"{passage} once more\nthird")]
    out = {r.doc_id: r.text for r in line_dedup.dedup(docs_of(spark, rows)).collect()}
    assert out == {1: rows[0][1], 2: f"second text here\n{brief}", 3: rows[2][1]}
    copies = [(1, f"one\n{passage}"), (2, f"one\n{passage}")]  # copies of one text alone make nothing recur
    assert {r.text for r in line_dedup.dedup(docs_of(spark, copies)).collect()} == {copies[0][1]}


def test_line_dedup_counts_texts_not_lines(spark):
    sales = lambda *names: "\n".join(f"Total sales in {x} were strong." for x in names)
    two = [(1, sales("Germany", "France")), (2, sales("Spain"))]
    assert {r.doc_id: r.text for r in line_dedup.dedup(docs_of(spark, two)).collect()} == dict(two)
    three = [*two, (3, sales("Italy", "Malta"))]
    for n in (3, 4):  # by the least and greatest text, and by all texts
        rows = three if n == 3 else [*three, (4, sales("Peru"))]
        out = {r.doc_id: r.text for r in line_dedup.dedup(docs_of(spark, rows), min_docs=n).collect()}
        assert out == {1: sales("Germany"), **{i: "" for i, _ in rows[1:]}}
    assert {r.doc_id: r.text for r in line_dedup.dedup(docs_of(spark, three), min_docs=4).collect()} == dict(three)


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></ul></nav>
<div class="cookie-notice">We use cookies</div><header>Site</header><div class="post post-{n}"><h2>Head &amp; more</h2><p>First   <b>bold</b>
text &eacute;<br>line.<p>Second paragraph that is long enough to count as running text.<ul><li>one<li>two</ul><!-- hidden --></div>
<aside>Side</aside><div class="comments"><p>Reader says hello to all of you out there.</p></div><form><p>Mail</p></form><footer>&copy; foot</footer></body></html>"""


def test_html_text(spark):
    want = "Head & more\nFirst bold text é line.\nSecond paragraph that is long enough to count as running text.\none\ntwo"
    rows = [(k, f"http://h.example/{k}", PAGE.format(n=k)) for k in range(3)]
    rows += [(10, None, None), (11, "http://h.example/e", ""), (12, "x", "<p>plain <a"), (None, "http://o.example", "no markup &lt;b&gt;"), (13, "http://h.example/z", "<div><p>alone</p>")]
    out = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert [out[k].text for k in range(3)] == [want] * 3 and out[0].path.endswith("div.post.post-#")
    assert out[10].text == out[11].text == "" and out[10].n_chars == 0
    assert out[12].text == "plain <a" and out[None].text == "no markup <b>" and out[13].text == "alone"
    assert html_text.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def edf_plain(blocks, weights):
    """(source, block, phase) of each slot: slot after slot, over exact windows, phase after phase."""
    left, used, out, phase = dict(blocks), dict.fromkeys(blocks, 0), [], 0
    while left:
        total = sum(weights[s] for s in left)
        done, t, names = dict.fromkeys(left, 0), 0, sorted(left, key=lambda s: (s is not None, str(s)))
        while all(left.values()):
            share = {s: weights[s] / total for s in left}
            free = [s for s in names if math.floor(done[s] / share[s]) <= t]
            s = min(free, key=lambda s: (math.ceil((done[s] + 1) / share[s]), names.index(s)))
            out.append((s, used[s], phase))
            done[s], used[s], left[s], t = done[s] + 1, used[s] + 1, left[s] - 1, t + 1
        left, phase = {s: n for s, n in left.items() if n}, phase + 1
    return out


def test_mixing_is_fair_and_whole(spark):
    rows = [(k, None, None, "big" if k % 3 else ("mid" if k % 2 else None), 0) for k in range(2000)] + [(5, None, None, "big", 0)]
    rows += [(None, str(k), None, "big", 0) for k in range(40)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("slot", F.lit("clash")).withColumn("h", F.lit(1)).withColumn("src", F.lit("x"))
    weights = {"big": 0.5, "mid": Fraction(3, 10), None: 1 / 5}
    out = mixing.mix(docs, weights, block_rows=10, bucket_rows=100).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in out) == sorted((r[0] or -1, r[1] or "") for r in rows)
    assert len({(r.slot, r.place) for r in out}) == len(rows) and out[0].h == 1 and out[0].src == "x"
    sizes = Counter(r[3] for r in rows)
    want = edf_plain({s: -(-n // 10) for s, n in sizes.items()}, {"big": Fraction(1, 2), "mid": Fraction(3, 10), None: Fraction(1, 5)})
    got = {r.slot: (r.source, r.block, r.phase) for r in out}
    assert [got[t] for t in range(len(got))] == want
    for phase in {p for _, _, p in want}:  # the bound, against the targets of the sources that are left
        own = [s for s, _, p in want if p == phase]
        total, done = sum(mixing.exact(weights[s]) for s in set(own)), Counter()
        for n, s in enumerate(own, 1):
            done[s] += 1
            assert all(abs(done[k] - n * mixing.exact(weights[k]) / total) < 1 for k in set(own))
    assert mixing.mix(docs_of(spark, [])).count() == 0
    assert mixing.in_order(mixing.mix(docs_of(spark, ODD))).count() == len(ODD)
    with pytest.raises(ValueError):
        mixing.mix(docs, {"big": math.sqrt(2), "mid": math.pi, None: 1}).count()


def test_mixing_order_is_laid_out_and_kept(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    rows = [(k, f"text {k}", None, f"s{k % 7 % 3}", 6) for k in range(3000)]
    docs = spark.createDataFrame(rows, DOCS)
    mixed = mixing.mix(docs, block_rows=1)
    want = [r.doc_id for r in sorted(mixed.collect(), key=lambda r: (r.slot, r.place))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    laid = mixing.in_order(mixed).withColumn("part", F.spark_partition_id()).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.part for r in laid}) > 1 and [r.doc_id for r in laid] == want
    want = [r.doc_id for r in sorted(mixing.mix(docs).collect(), key=lambda r: (r.slot, r.place))]
    out = corpus_pipeline.tokens(spark, corpus_pipeline.mixture(spark, docs, "").repartition(5), "").collect()
    places = [r.mix_position for r in out]
    assert len(set(places)) == len(rows) and [r.doc_id for r in sorted(out, key=lambda r: r.mix_position)] == want
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages = [("shuffled", lambda s, d, _: corpus_pipeline.mixture(s, d, "").repartition(5)), ("bpe", corpus_pipeline.tokens)]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    assert [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()] == want


@pytest.mark.parametrize("seed", range(6))
def test_schedule_bound(seed):
    rng = random.Random(seed)
    share = mixing.integers({f"s{k}": Fraction(rng.randint(1, 40)) for k in range(rng.randint(1, 12))})
    slots, period = mixing.schedule(share), sum(share.values())
    assert sorted(itertools.chain(*slots.values())) == list(range(period))
    for s, own in slots.items():
        for n in range(1, period + 1):
            assert abs(sum(x < n for x in own) - Fraction(n * share[s], period)) < 1


def test_mixing_bound_against_the_targets_at_any_length():
    weights = {"a": 1 / 3, "b": 1 / 3, "c": 0.3, "d": 1 / 30}
    exact = {s: mixing.exact(w) for s, w in weights.items()}
    assert exact == {"a": Fraction(1, 3), "b": Fraction(1, 3), "c": Fraction(3, 10), "d": Fraction(1, 30)}
    slots = 120_000
    rows = {r["source"]: r for r in mixing.plan({s: slots for s in weights}, exact) if r["phase"] == 0}
    at = np.full(slots, "", dtype=object)
    for s, r in rows.items():
        k = np.arange(slots)
        place = r["period"] * (k // r["share"]) + np.array(r["slots"])[k % r["share"]]
        at[place[place < slots]] = s
    for s, w in weights.items():
        assert np.abs(np.cumsum(at == s) - np.arange(1, slots + 1) * float(exact[s])).max() < 1
    rounded = mixing.whole_weights({k: random.Random(k).random() for k in range(30)}, 997)
    assert sum(rounded.values()) == 997 and min(rounded.values()) >= 1


def test_pipeline_matches_plain_stages(spark, tmp_path):
    import corpus_pipeline

    prose = lambda k: " ".join(random.Random(k).choices("alpha beta gamma delta the of and to in is river stone light water green".split(), k=90)) + "."
    rows = [(k, prose(k) + f"\nshared closing line of all texts\nown {k} end of it.") for k in range(30)]
    rows += [(100, rows[0][1]), (101, "short"), (None, prose(77)), (103, None)]
    sf = str(tmp_path)
    docs_of(spark, rows).withColumn("clash", F.lit(1)).write.parquet(f"{sf}/documents.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = corpus_pipeline.quality(spark, docs, sf)
    assert sorted(a.columns) == sorted(docs.columns) and a.count() == 32
    b = corpus_pipeline.lines(spark, a, sf)
    assert b.columns == docs.columns and b.count() == 32
    c = corpus_pipeline.near_duplicates(spark, b, sf)
    assert c.columns == docs.columns
    d = corpus_pipeline.mixture(spark, c, sf)
    assert sorted(r.doc_id or -1 for r in d.collect()) == sorted(r.doc_id or -1 for r in c.collect())
    out = corpus_pipeline.run(spark, sf)
    assert out.count() == c.count() and out.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256"]
