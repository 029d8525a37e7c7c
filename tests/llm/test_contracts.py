"""Registered queries against their SQL or a brute-force version, and every operator under clashing names, nulls, empty tables and very long texts."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fusemill.llm import ann, bpe, chat, html_text, license_scan, line_dedup, mixing, near_sets, quality_rules, queries, simhash, weak_quality
from tests.llm.test_llm import DOCS, PAGE, SPACE, docs_of, edf_plain, near_groups_plain

SMALL = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "embeddings", "conversations", "labels", "benchmark")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def plain_rows(columns, rows):
    show = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(str([show(r[c]) for c in sorted(columns)]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SMALL)
    want = duck.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain_rows(got.columns, [r.asDict() for r in got.collect()]) == plain_rows(got.columns, want.astype(object).where(want.notna(), None).to_dict("records"))


# names that the operators use for themselves, or add
NAMES = """
row id text key whole all drop toks at few docs rules low high n c no leaf line template piece texts slot h tie src bucket r seq start phase block place to_source of_src run host part
runs blocks won of_host p _whole _words _places _base _blocks _p0 _all _good _lines _hashes _packed _twins _spelled _row kept loss clean_text n_words n_chars _key _id fp _point first label
score labels matches quality n_lines n_dropped mix_position path
""".split()


def clashing(df, but=()):
    own = {c.lower() for c in df.columns} | set(but)
    extra = [n for n in NAMES if n not in own]
    return df.select("*", *[F.lit(f"own {n}").alias(n) for n in extra]), extra


def unharmed(rows, extra, made):
    return all(r[n] == f"own {n}" for r in rows for n in extra if n not in made)


ROWS = [(k, " ".join(random.Random(k).choices("alpha beta gamma delta the of and to in is river".split(), k=70)) + f".\nshared line of five words\nown {k} end.") for k in range(6)]
ODD_ROWS = [*ROWS, (None, ROWS[0][1]), (None, None), (7, None), (8, ""), (3, ROWS[3][1])]
ON_DOCS = {
    "op3": (line_dedup.dedup, ("n_lines", "n_dropped")),
    "op3 alone": (line_dedup.freed, ()),
    "op4": (quality_rules.clean, (*quality_rules.COUNTS, "clean_text", "lost_chars", "loss", "kept")),
    "op4 counts": (quality_rules.with_counts, quality_rules.COUNTS),
    "op4 keep": (quality_rules.keep, ()),
    "op7": (mixing.mix, ("phase", "slot", "block", "place")),
    "op7 order": (lambda d: mixing.ordered(d, "mix_position"), ("mix_position",)),
    "op9": (license_scan.scan, ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")),
    "op10 keep": (simhash.keep_one, ()),
    "near sets": (near_sets.keep_one, ()),
    "op2": (lambda d: weak_quality.classify(d, weak_quality.fit(d)), ("quality", "kept")),
}


@pytest.mark.parametrize("name", ON_DOCS)
def test_names_nulls_and_empty_tables(spark, name):
    operator, made = ON_DOCS[name]
    docs, extra = clashing(docs_of(spark, ODD_ROWS), ("text",))
    out = operator(docs)
    rows = out.collect()
    assert len(set(map(str.lower, out.columns))) == len(out.columns) and unharmed(rows, extra, made)
    assert set(docs.columns) | set(made) == set(out.columns)
    if name not in ("op4 keep", "op10 keep", "near sets"):
        assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in ODD_ROWS)
    empty = operator(docs.limit(0))
    assert empty.columns == out.columns and empty.count() == 0


def test_other_tables_under_clashing_names(spark):
    pages = spark.createDataFrame([(k, "http://h.example/x", PAGE.format(n=k)) for k in range(3)] + [(None, None, None)], "page_id bigint, url string, html string")
    made = ("host", "path", "text", "n_chars")
    df, extra = clashing(pages)
    out = html_text.extract(df)
    assert unharmed(out.collect(), extra, made) and set(out.columns) == set(df.columns) | set(made) and html_text.extract(df.limit(0)).count() == 0
    v = spark.createDataFrame([(k, np.random.default_rng(k).normal(size=8).tolist()) for k in range(60)], "vec_id bigint, embedding array<double>")
    w, _ = clashing(v)
    near = ann.search(w, w.where("vec_id % 50 = 0"), ann.build(w))
    assert near.count() == 10 and ann.search(w.limit(0), w.limit(0), ann.build(w.limit(0))).count() == 0
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id bigint, turn bigint, role string, text string")
    c, _ = clashing(turns)
    assert chat.summary(chat.examples(c)).count() == 1 and chat.summary(chat.examples(c.limit(0))).count() == 0
    d, _ = clashing(docs_of(spark, ODD_ROWS), ("text",))
    assert simhash.near_duplicates(d).count() == len(ODD_ROWS) and simhash.near_duplicates(d.limit(0)).count() == 0
    assert d.limit(0).select(bpe.encode_digest(F.col("text"), queries.tokenizer_path())).count() == 0


LONG = " ".join(f"word{k % 977}" for k in range(400_000))


def test_very_long_texts(spark):
    lined = "\n".join(" ".join(f"w{chr(97 + (k * j) % 26)}{chr(97 + k % 26)}" for j in range(12)) + "." for k in range(20_000))
    rows = [(1, LONG), (2, LONG + " more"), (3, lined), (4, lined + "\nlast line of all the lines here.")]
    docs = docs_of(spark, rows)
    assert {r.doc_id: r.n_words for r in quality_rules.clean(docs).collect()} == {i: len(t.split()) for i, t in rows}
    assert {r.doc_id for r in near_sets.keep_one(docs).collect()} == {1, 3}
    out = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert out[2] == 1 and out[4] == 3
    assert line_dedup.dedup(docs).count() == 4 and license_scan.scan(docs).where("n_words > 200000").count() == 4
    c = bpe.Codec(queries.tokenizer_path())
    assert c.decode(c.encode(LONG)) == LONG and c.taken <= bpe.TABLE_BYTES
    page = spark.createDataFrame([(1, "http://x.example", f"<body><article>{'<p>' + LONG[:200] + '</p>'}{'<p>par agraph</p>' * 50_000}</article></body>")], "page_id bigint, url string, html string")
    assert html_text.extract(page).first().text.count("\n") == 50_000
    talk = spark.createDataFrame([(1, 0, "user", LONG), (1, 1, "assistant", LONG)], "conv_id bigint, turn bigint, role string, text string")
    assert chat.summary(chat.examples(talk)).first().loss_sha256 == hashlib.sha256(LONG.encode()).hexdigest()


def test_chat_roles_read_back(spark):
    roles = ["a\nb", "a\\nb", "\\\n", "<|n|>", "\n<|im_end|>", "", None]
    rows = [(k, 0, r, "t") for k, r in enumerate(roles)] + [(None, k, "user", f"lone {k}") for k in range(3)]
    out = chat.summary(chat.examples(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))).collect()
    got = {r.conv_id: r.turns_sha256 for r in out if r.conv_id is not None}
    assert got == {k: hashlib.sha256(f"{r or ''}\nt\n".encode()).hexdigest() for k, r in enumerate(roles)}
    assert sum(r.conv_id is None for r in out) == 3  # a null id is no conversation


def test_license_statements_over_lines(spark):
    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted"
    mpl = "Text before it.\nThis Source Code Form is subject to the\nterms of the Mozilla Public\nLicense, v. 2.0."
    apache = "x Licensed under the Apache License,\nVersion 2.0"
    out = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(docs_of(spark, [(1, bsd), (2, mpl), (3, apache), (4, "Nothing of the kind.\nAt all.")])).collect()}
    assert out == {1: ("bsd", 1.0), 2: ("mpl", 1.0), 3: ("apache", 1.0), 4: ("", 0.0)}


def test_boilerplate_in_four_languages(spark):
    prose = "\n".join(" ".join(f"wort{k}{j}" for j in range(12)) + "." for k in range(20))
    lines = ["Bitte hier klicken und weiterlesen auf dieser Seite.", "Tous droits réservés par notre maison depuis toujours.", "Todos los derechos reservados por la casa editorial.", "Please click here to read all of it today."]
    out = quality_rules.clean(docs_of(spark, [(1, "\n".join([prose, *lines]))])).first()
    assert out.clean_text == prose and out.lost_chars == sum(map(len, lines))


def html_plain(rows):
    """Every page's text by a vote of dictionaries: all paths with text, squared thrice against the page's best."""
    pages = {k: html_text.parse(h or "") for k, (_, _, h) in enumerate(rows)}
    host = {k: (m[1].lower() if (m := re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", u or "")) else "") for k, (_, u, _) in enumerate(rows)}
    votes, held = defaultdict(Counter), {}
    for k, page in pages.items():
        by = defaultdict(list)
        for e in page.containers:
            if e.text > 0:
                by[e.path if e.tag else ""].append(e)
        totals = {p: sum(max(0.0, e.text - 2.0 * e.links) * html_text._BONUS.get(e.tag, 1.0 if e.tag else 0.8) for e in es) for p, es in by.items()}
        top = max((s for p, s in totals.items() if p), default=0)
        for p, s in totals.items():
            if p and top:
                votes[host[k]][p] += (s / top) ** 8
        held[k] = by, totals
    won = {h: max(v, key=lambda p: (round(v[p], 6), p.count("/"), p)) for h, v in votes.items()}  # noqa: B023
    out = []
    for k, page in pages.items():
        by, totals = held[k]
        path = won.get(host[k]) if won.get(host[k]) in by else max(by, key=lambda p: (totals[p], p.count("/"), -min(e.order for e in by[p])), default=None)  # noqa: B023
        spans = sorted((e.start, e.end) for e in by[path]) if path is not None else []
        out.append("\n".join(b for a, z in spans for b in page.blocks[a:z]))
    return out


def test_html_query_by_brute_force(spark):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    want = dict(zip([p[0] for p in pages], html_plain(pages), strict=True))
    got = queries.QUERIES["op6_html_text"](spark, SMALL).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_html_keeps_all_containers_on_the_path(spark):
    two = "<body><article><p>First part of the text stands here.</p></article><div class='ad'>buy</div><article><p>Second part of the text stands there.</p></article></body>"
    deep = "<body>" + "<div class='x'>" * 9 + "<p>Deep text that is long enough to count.</p>" + "</div>" * 9 + "</body>"
    rows = [(k, "http://a.example/", two) for k in range(3)] + [(k, "http://b.example/", deep) for k in range(10, 13)]
    out = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert out[0] == "First part of the text stands here.\nSecond part of the text stands there." and out[10] == "Deep text that is long enough to count."
    few = html_text.BROADCAST_HOSTS
    try:
        html_text.BROADCAST_HOSTS = 0  # the way for many hosts
        again = html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    finally:
        html_text.BROADCAST_HOSTS = few
    assert {r.page_id: r.text for r in again} == out


def votes_plain(text):
    t = text or ""
    w = [x for x in re.split(SPACE, t) if x]
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    repeat = len({i + k for p in at.values() if len(p) > 1 for i in p for k in range(3)})
    full = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, symbols, dup, lines = len(w), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), t.count("\n") + 1
    ended, capitals = len(re.findall(r"[.!?…:;][\"'”’»)]*\s*(?:\n|$)", t)), len(re.findall(r"[A-ZÀ-Þ]{2}", t))
    function = len(re.findall(r"(?i)(?<!\S)(?:" + "|".join(weak_quality.FUNCTION_WORDS) + r")(?!\S)", t))
    vote = lambda bad, good=False: 0 if bad else 1 if good else -1
    return (
        vote(n < 50), vote(symbols * 20 > n, symbols * 100 <= n), vote(repeat * 3 > n, repeat * 10 <= n), vote(dup > 3 and dup * 3 > lines),
        vote(ended * 3 < lines, ended * 5 >= lines * 3), vote(capitals * 5 > n, capitals * 50 <= n), vote(function * 50 < n, function * 12 >= n),
    )


def features_plain(text):
    """The hashed features word by word."""
    out = np.zeros(weak_quality.DIM)
    words = [x for x in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode("utf-8", "replace")) if x]
    half, mask, hashes = weak_quality.DIM // 2, (1 << 64) - 1, []
    kind = lambda b: 4 + (b in b"!?;:"[0:0] or b in b":!?") if b in b".,;:!?" else 2 if 48 <= b <= 57 else 1 if 65 <= b <= 90 else 0 if 97 <= b <= 122 or b >= 128 else 3
    for w in words:
        h = sum((b + 1) * ((k * 2654435761 + 40503) | 1) for k, b in enumerate(w)) & mask
        hashes.append(h)
        out[h % half] += 1 / len(words)
        shape = ((kind(w[0]) * 8 + kind(w[-1])) * 8 + min(len(w) // 2, 7)) * 3 + min(sum(kind(b) == 3 for b in w), 2)
        out[half + shape % (half - 8)] += 1 / len(words)
    if words:
        out[-1] = np.mean([a == b for a, b in zip(hashes, hashes[1:], strict=False)]) if len(words) > 1 else 0.0
        out[-2], out[-3] = 1 / (1 + len(words) / 50), 1 - len(set(hashes)) / len(hashes)
    return out


def test_weak_quality_query_by_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    voted = [votes_plain(t) for _, t in docs]
    seen = Counter(voted)
    patterns = np.array(sorted(seen))
    _, _, post = weak_quality.fit_labellers(patterns, np.array([seen[tuple(p)] for p in patterns.tolist()], dtype=float))
    posterior = {tuple(p): q for p, q in zip(patterns.tolist(), post, strict=True)}
    x = np.array([features_plain(t) for _, t in docs])
    scorer = weak_quality.train(x, np.array([posterior[v] for v in voted]))
    want = dict(zip([i for i, _ in docs], scorer.score(x), strict=True))
    got = {r.doc_id: r for r in queries.QUERIES["op2_weak_quality"](spark, SMALL).collect()}
    assert set(got) == set(want) and max(abs(got[i].quality - q) for i, q in want.items()) < 1e-3
    assert all(got[i].kept == (q >= 0.5) for i, q in want.items() if abs(q - 0.5) > 1e-3)


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_ann_query_recall(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = defaultdict(list)
    for r in queries.QUERIES["op1_ann"](spark, f"/root/testdata/{sf}").collect():
        got[r.query_id].append(r.vec_id)
    hit = total = 0
    for k in np.flatnonzero(ids % 50 == 0):
        sims = x @ x[k]
        sims[k] = -9
        best = ids[np.lexsort((ids, -np.round(sims, 12)))[:5]]
        hit, total = hit + len(set(best) & set(got[ids[k]])), total + 5
    assert hit / total >= 0.9


def test_ann_walk_stops_early():
    x = np.random.default_rng(1).normal(size=(4000, 16))
    x = np.repeat(x[:40], 100, axis=0) + 0.15 * x  # forty clouds
    index = ann.fit(x)
    visited = [len(v) for v in index.visits(ann._unit(x[::100]))]
    assert np.mean(visited) < 0.1 * len(index.centroids)


def signed(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def dedup_two_rules(rows, depth=3, min_tokens=4, rules=((3, 0), (2, 50)), min_constant=0.6):
    """The template tree, rule by rule, one line after the other."""
    lines = []
    for i, t in rows:
        for no, raw in enumerate(t.split("\n") if t is not None else []):
            toks = tuple(x for x in re.split(SPACE, re.sub(r"[^\x20\x09-\x0D]*\d[^\x20\x09-\x0D]*", "<*>", raw)) if x)
            if len(toks) >= min_tokens:
                lines.append((i, t, no, toks, (len(toks), *toks[:depth])))
    drop = set()
    for need, least in rules:
        fit = [x for x in lines if len(x[3]) >= least]
        texts = defaultdict(set)
        for _, t, _, toks, leaf in fit:
            for at, tok in enumerate(toks):
                texts[leaf, at, tok].add(t)
        groups = defaultdict(list)
        for i, t, no, toks, leaf in fit:
            marks = tuple(tok if tok != "<*>" and len(texts[leaf, at, tok]) >= need else None for at, tok in enumerate(toks))
            if sum(m is not None for m in marks) / len(marks) >= min_constant:
                groups[leaf, marks].append(((i is not None, i or 0, no, signed(t)), i, t, no))
        for g in groups.values():
            if len({t for _, _, t, _ in g}) >= need:
                first = min(g)[0]
                drop |= {(i, t, no) for k, i, t, no in g if k != first}
    return {(i, t): "\n".join(x for no, x in enumerate(t.split("\n")) if (i, t, no) not in drop) for i, t in rows if t is not None}


def near_lines(rng, k):
    """Texts whose long lines differ in a few words, so that pieces agree and disagree."""
    base = [[f"{chr(97 + g)}{rng.randrange(400)}x".replace("0", "o").translate(str.maketrans("123456789", "abcdefghi")) for _ in range(rng.choice((9, 40, 55, 130)))] for g in range(8)]
    rows = []
    for d in range(k):
        lines = []
        for line in rng.sample(base, 4):
            words = list(line)
            for at in rng.sample(range(3, len(words)), rng.choice((0, 0, 1, 4))):
                words[at] = rng.choice(("red", "blue", "7"))
            lines.append(" ".join(words))
        rows.append((d if d % 9 else None, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", (1, 2))
def test_line_dedup_by_brute_force(spark, seed):
    rows = near_lines(random.Random(seed), 30)
    want = dedup_two_rules(rows)
    out = line_dedup.dedup(docs_of(spark, rows).withColumn("was", F.col("text"))).collect()
    assert [(r.doc_id, r.text) for r in out] == [(r.doc_id, want[r.doc_id, r.was]) for r in out]
    gone = line_dedup.dedup(docs_of(spark, rows), keep_first=False).collect()
    assert sum(r.n_dropped for r in gone) > sum(r.n_dropped for r in out)


def quality_plain(text):
    """The text without failing lines, or None where the document is rejected."""
    from tests.llm.test_llm import quality_of

    def fails(x):
        stub = re.fullmatch(r"\s*\S+(\s+\S+){0,2}\s*", x) and not re.search(quality_rules.TERMINAL, x)
        short = len(x) < 200 and (stub or re.search(quality_rules.BOILERPLATE.replace(r"[^\p{L}\p{N}_]", r"[^\w]"), x))
        return bool(short) or len(re.findall(r"[#*$%&|<>]", x)) * 10 > len(x) > 0

    lines = text.split("\n")
    good = [x for x in lines if not fails(x)]
    kept = list(dict.fromkeys(good)) if quality_of(text)[3] > 0 else good
    lost = len("".join(lines)) - len("".join(kept))
    return None if quality_of(text)[5] or lost / max(1, len(text)) > 0.4 else "\n".join(good)


def test_pipeline_by_brute_force(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("riv", "sto", "lam", "gre", "wat", "hil", "tor") for b in ("er", "ne", "p", "en", "l", "um", "is")]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n)) + "."
    passage = prose(60)
    rows = [(k, f"{prose(120)}\nHome\nclosing line of every text here.\n{prose(12)}") for k in range(60)]
    rows += [(100 + k, rows[k][1] if k % 2 else rows[k][1].replace("river", "stone", 1)) for k in range(12)]  # copies and near copies
    rows += [(200 + k, f"{prose(100)}\n{passage}") for k in range(2)] + [(300, "too short"), (301, None), (302, "# % & | < > " * 30 + prose(60))]
    docs = docs_of(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    source = {i: f"s{i % 3}" for i, _ in rows}
    kept = [(i, q) for i, t in rows if t is not None and (q := quality_plain(t)) is not None]
    cleaned = dedup_two_rules(kept)
    kept = [(i, cleaned[i, t]) for i, t in kept]
    label = near_groups_plain([t for _, t in kept])
    first = {}
    for (i, _), g in zip(kept, label, strict=True):
        first[g] = min(first.get(g, i), i)
    kept = [(i, t) for i, t in kept if i in set(first.values())]
    marks = {r.i: r.h for r in spark.createDataFrame([(i,) for i, _ in kept], "i bigint").select("i", F.xxhash64(F.col("i"), F.lit(17)).alias("h")).collect()}
    per = defaultdict(list)
    for i, _ in kept:
        per[source[i]].append(i)
    blocks = {s: [sorted(v, key=marks.get)[a : a + mixing.BLOCK_ROWS] for a in range(0, len(v), mixing.BLOCK_ROWS)] for s, v in per.items()}
    weights = mixing.whole_weights({s: math.sqrt(len(v)) for s, v in per.items()})
    order = [i for s, b, _ in edf_plain({s: len(b) for s, b in blocks.items()}, {s: mixing.exact(w) for s, w in weights.items()}) for i in blocks[s][b]]
    library, texts = Tokenizer.from_file(queries.tokenizer_path()), dict(kept)
    want = []
    for i in order:
        ids = library.encode(texts[i], add_special_tokens=False).ids
        want.append((i, source[i], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest()))
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert len(want) < len(rows) - 10 and got == want


def test_pipeline_of_an_empty_table_and_clashing_names(spark, tmp_path):
    import corpus_pipeline

    docs, _ = clashing(docs_of(spark, ROWS), ("text",))
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() == len(ROWS)
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
    stage = docs
    for _, fn in corpus_pipeline.STAGES[:-1]:
        stage = fn(spark, stage, "")
        assert set(docs.columns) <= set(stage.columns)
