"""License scans by an exact set-similarity join against license templates.

Text blocks and templates are sets of words. A block is a line and the words that follow it, up to as many as the longest template has, so that a
statement that is broken over lines stands whole in the block of the line where it begins. Words get one global order, rarest first, from their document
counts over the whole corpus. A template of t distinct words must share o = ceil(threshold * t) of them with a block,
so one of its t - o + 1 rarest words stands in every such block and among the block's own first words (prefix
filter); a block with fewer than o template words can't match (length filter); nor can one whose words after the
common one are too few (positional filter). What is left is verified exactly. Words in no template can't add to the
overlap and are left out of the blocks.

Templates that differ in fewer words than the threshold allows, as those of the GPL's sisters, would match each other's texts; only one of such a family is in
the table.

The templates are a fixed, small parameter and go into the plan as literals, so the join is a narrow transformation:
no shuffle, no hot key, no broadcast of data. The one aggregate is the count of template words over the corpus: at most
one row for each template word. DataFrame functions only.

Defined results: null text counts as empty (0 words, no places, null first and last word, empty labels, score 0); null
doc_id passes; repeated rows are scanned each for itself; an empty table gives an empty result; further columns of the input
pass through under any name, and one named like an added column is replaced. Texts of any length are scanned whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fusemill.llm.common import boxed, named, unboxed

# Phrases and their labels, and the templates of the method with theirs.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software"),
)

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def license_words(text: Column) -> Column:
    """A-Z lower-cased; words of digits, a-z and characters beyond ASCII."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lowered, _SEPARATORS), "")


def _literal(values) -> Column:
    return F.array(*[F.lit(x) for x in values])


def reach(templates: tuple[tuple[str, str], ...]) -> int:
    """Words after a line that still belong to its block."""
    return max((len(words.split()) for _, words in templates), default=0)


def _blocks(text: Column, words: Column, more: int) -> Column:
    """The words of each block: those of a line and the ``more`` words after it. words: all of the text's, which are its lines' one after another."""
    counts = F.transform(F.split(text, "\n"), lambda x: F.size(license_words(x)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,n:int>>").alias("out"))
    spans = F.aggregate(counts, start, lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["out"], F.struct(s["at"].alias("at"), n.alias("n"))).alias("out")), lambda s: s["out"])
    return F.transform(spans, lambda p: F.slice(words, p["at"] + 1, p["n"] + more))


def word_frequency(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, int]:
    """Documents that hold each word of ``vocabulary``: at most len(vocabulary) rows come to the driver."""
    found = F.array_intersect(license_words(named(text_col)), _literal(vocabulary))
    rows = docs.select(F.explode(found).alias("w")).groupBy("w").count().collect()
    return dict.fromkeys(vocabulary, 0) | {r["w"]: r["count"] for r in rows}


def _matches(block: Column, templates: list[tuple[str, list[str]]], order: list[str], threshold: float) -> Column:
    """Array of (label, containment) of the templates that ``block``, its words in global order, contains."""
    rank = {w: i for i, w in enumerate(order)}
    out = []
    for label, words in templates:
        ordered = sorted(words, key=rank.__getitem__)
        t = len(ordered)
        need = max(1, math.ceil(threshold * t - 1e-9))
        prefix = ordered[: t - need + 1]
        n = F.size(block)
        place = [F.array_position(block, w).cast("int") for w in prefix]  # from 1; 0: not there
        # common word at place p (from 1) of the block and i (from 0) of the template: n - p + 1 and t - i bound the overlap
        bounded = [(p > 0) & (p <= n - need + 1) & (F.least(n - p + 1, F.lit(t - i)) >= need - F.lit(i)) for i, p in enumerate(place)]
        candidate = bounded[0]
        for c in bounded[1:]:
            candidate = candidate | c
        overlap = F.size(F.array_intersect(block, _literal(words)))
        share = overlap.cast("double") / F.lit(float(t))
        out.append(F.when((n >= need) & candidate & (overlap >= need), F.struct(F.lit(label).alias("label"), share.alias("share"))))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def scan(
    docs: DataFrame,
    text_col: str = "text",
    phrases: dict[str, str] | None = None,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    threshold: float = 0.8,
) -> DataFrame:
    """Input columns plus n_words, n_base, first_word, last_word, base_labels, labels, score and matches.

    matches: array of (block number from 0, label, containment) of the blocks that reach ``threshold``. score: the
    greatest containment, 1 where a base phrase stands, else 0.
    """
    phrases = PHRASES if phrases is None else phrases
    sets = [(label, sorted(set(words.split()))) for label, words in templates]
    vocabulary = sorted({w for _, words in sets for w in words})
    frequency = word_frequency(docs, vocabulary, text_col)
    order = sorted(vocabulary, key=lambda w: (frequency[w], w))
    prefixes = set()
    for _, words in sets:
        ordered = sorted(words, key=order.index)
        prefixes |= set(ordered[: len(ordered) - max(1, math.ceil(threshold * len(ordered) - 1e-9)) + 1])

    whole = F.coalesce(named(text_col), F.lit(""))
    df = docs.select(boxed(docs), whole.alias("_whole"), license_words(whole).alias("_words"))
    w = F.col("_words")
    spelled = [(p.split(), label) for p, label in phrases.items()]
    firsts = sorted({p[0] for p, _ in spelled})
    stands = lambda words, i: F.coalesce(
        F.expr("true") if not words else _all(F.get(w, i + k) == F.lit(x) for k, x in enumerate(words)), F.lit(False)
    )
    at = lambda words: F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: stands(words, i))
    nothing = F.array().cast("array<int>")
    possible = F.arrays_overlap(w, _literal(firsts))
    df = df.withColumns({f"_p{k}": F.when(possible & F.array_contains(w, p[0]), at(p)).otherwise(nothing) for k, (p, _) in enumerate(spelled)})
    places = F.concat(*[F.col(f"_p{k}") for k in range(len(spelled))])
    base = F.array_compact(F.array(*[F.when(F.size(f"_p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(spelled)]))

    each = _blocks(F.col("_whole"), w, reach(templates))
    blocks = F.transform(each, lambda x, i: F.struct(i.alias("block"), F.array_intersect(_literal(order), x).alias("words")))
    df = df.withColumns({"_places": places, "_base": base})
    # a text without any word of a template's prefix holds no match
    df = df.withColumn("_blocks", F.when(F.arrays_overlap(w, _literal(sorted(prefixes))), blocks))
    found = F.flatten(
        F.transform(
            "_blocks",
            lambda b: F.transform(
                _matches(b["words"], sets, order, threshold), lambda m: F.struct(b["block"].alias("block"), m["label"].alias("label"), m["share"].alias("share"))
            ),
        )
    )
    df = df.withColumn("matches", F.coalesce(found, F.array().cast("array<struct<block:int,label:string,share:double>>")))
    labels = F.array_sort(F.array_union("_base", F.transform("matches", lambda m: m["label"])))
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0))
    return unboxed(
        df,
        docs.columns,
        n_words=F.size("_words").cast("long"),
        n_base=F.size("_places").cast("long"),
        first_word=F.array_min("_places").cast("long"),
        last_word=F.array_max("_places").cast("long"),
        base_labels=F.array_join(F.array_sort(F.array_distinct("_base")), ","),
        labels=F.array_join(F.array_distinct(labels), ","),
        score=F.when(F.size("_places") > 0, F.lit(1.0)).otherwise(best),
        matches=F.col("matches"),
    )


def _all(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out
