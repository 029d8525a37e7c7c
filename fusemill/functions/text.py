"""Text normalisation as column expressions (JVM side, but for Unicode folding)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(text: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _folds() -> dict[str, str]:
    """Letters whose folded form isn't their lower case, by the rule of Unicode; the capital sigma is among them, since its lower case depends on its place."""
    out = {c: c.casefold() for c in map(chr, range(0x80, 0x20000)) if c.casefold() != c.lower()}
    return out | {"\u03a3": "\u03c3"}


FOLDS = _folds()


def _ranges(letters: list[str]) -> str:
    """The inside of a character class."""
    points, out = sorted(map(ord, letters)), []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out)


def casefold(text: Column) -> Column:
    """Case folding: lower case, and the letters of FOLDS. Only texts beyond ASCII are searched for those, and only texts that have some are cut at them."""
    folds = F.create_map(*[F.lit(x) for pair in FOLDS.items() for x in pair])
    odd_letter = _ranges(list(FOLDS))
    pieces = F.regexp_extract_all(text, F.lit(f"[{odd_letter}]|[^{odd_letter}]+"), F.lit(0))
    each = F.transform(pieces, lambda c: F.coalesce(F.try_element_at(folds, c), F.lower(c)))
    odd = (F.octet_length(text) > F.length(text)) & text.rlike(f"[{odd_letter}]")
    return F.when(odd, F.array_join(each, "")).otherwise(F.lower(text))


def tight(text: Column) -> Column:
    """Bar as space, no space before closing punctuation nor inside brackets, white space collapsed."""
    out = F.regexp_replace(F.replace(text, F.lit("|"), F.lit(" ")), r"\s+", " ")
    out = F.regexp_replace(out, r" ([,.;:!?%)\]}])", "$1")
    return F.trim(F.regexp_replace(out, r"([(\[{]) ", "$1"))


def matching_form(text: Column) -> Column:
    """Case folded and tight."""
    return tight(casefold(text))


def query_form(text: Column) -> Column:
    """What queries are matched in: compatibility form, case and diacritics folded, tight; leading articles stay."""
    return tight(fold(text))


def extraction_form(text: Column) -> Column:
    """What extractors read: white space collapsed, without bracketed length marks and (listen)."""
    out = F.regexp_replace(collapse(F.coalesce(text, F.lit(""))), r"\s*\[[\s\dːˈˌ]+\]\s*", " ")
    return collapse(F.regexp_replace(out, r"(?i)\s*\(listen\)\s*", " "))


def compact_form(text: Column) -> Column:
    return F.regexp_replace(matching_form(text), r"\s+", "")


def contains_normalized(haystack: Column, needle: Column) -> Column:
    """Containment of the matching forms, or of the compact ones; an empty needle is never contained."""
    a, b = matching_form(haystack), matching_form(needle)
    return (b != "") & (F.contains(a, b) | F.contains(compact_form(haystack), compact_form(needle)))


def answer_form(text: Column) -> Column:
    """Lower case; articles go before punctuation does; white space collapsed."""
    out = F.regexp_replace(F.lower(text), r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])", " ")
    return collapse(F.regexp_replace(out, r"[!-/:-@\[-`{-~]", ""))


def question_id(text: Column) -> Column:
    return F.sha2(F.regexp_replace(text, r"^\s+|\s+$", ""), 256)


def question_text_hash(text: Column) -> Column:
    return F.sha2(collapse(F.lower(text)), 256)


def last_answer(text: Column) -> Column:
    """What follows the last ``answer:``, or the whole text."""
    found = F.regexp_extract(text, r"(?is)^.*\banswer\s*:(.*)$", 1)
    return F.trim(F.when(text.rlike(r"(?is)\banswer\s*:"), found).otherwise(text))


def sentences(text: Column) -> Column:
    """Pieces between white space that follows an end mark."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def ordered_distinct(values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(values, lambda s: F.trim(s)), lambda s: s != ""))


def path_segment(text: Column) -> Column:
    """A text as one path segment; ``unknown`` where nothing is left."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"[^A-Za-z0-9._-]+", "-"), r"^-+|-+$", "")
    return F.when(out == "", "unknown").otherwise(out)


# Words that make a label less specific.
LABEL_STOP_WORDS = """
a an the and or but if in is it of on at to as by no we he be do me my up was were are
for not with from that this when who whom which what how why her him his has had may out
new can did its now one any all our she own too few per via etc
""".split()


def label_shape(norm: Column) -> Column:
    """How specific a normalised label looks, 0.05 to 1: two to five tokens are best; digits, stop words and other signs than letters lower it."""
    label = F.regexp_replace(norm, r"^\s+|\s+$", "")
    tokens = F.filter(F.split(F.lower(label), r"\s+"), lambda t: t != "")
    n, chars = F.size(tokens), F.greatest(F.length(label), F.lit(1)).cast("double")
    length = F.when(n <= 1, 0.55).when(n <= 5, 0.75 + 0.05 * (n - 2)).otherwise(F.greatest(F.lit(0.45), 0.95 - 0.04 * (n - 5)))
    stops = F.size(F.filter(tokens, lambda t: t.isin(LABEL_STOP_WORDS))) / F.greatest(n, F.lit(1)).cast("double")
    digits = F.regexp_count(label, F.lit(r"\p{Nd}")) / chars
    letters = F.regexp_count(label, F.lit(r"\p{L}")) / chars
    shape = length * (1 - F.least(F.lit(0.85), digits * 2)) * (1 - F.least(F.lit(0.5), stops * 1.2)) * (0.55 + 0.45 * F.least(F.lit(1.0), letters))
    return F.when(F.coalesce(label, F.lit("")) == "", 0.05).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(1.0), shape)))


def _fold(texts: pd.Series) -> pd.Series:
    def one(t):
        if t is None:
            return None
        wide = unicodedata.normalize("NFKC", t).casefold()
        return "".join(c for c in unicodedata.normalize("NFKD", wide) if not unicodedata.combining(c)).replace("ʿ", "").replace("ʼ", "")

    return texts.map(one)


def fold(text: Column) -> Column:
    """Compatibility form, case folded, without diacritics and modifier apostrophes (Arrow batches: Spark has no Unicode forms)."""
    return F.pandas_udf(_fold, "string")(text)


def entity_key(text: Column) -> Column:
    """Folded, without (…) and 's, words and hyphens only, without leading articles."""
    out = F.regexp_replace(fold(text), r"\([^)]*\)", "")
    out = F.regexp_replace(out, r"(?U)['’]s\b", "")
    out = collapse(F.regexp_replace(out, r"(?U)[^\w\s-]", " "))
    return F.regexp_replace(out, r"^((the|a|an)\s+)+", "")


def sentence_spans(text: Column) -> Column:
    """Array of (start, end) of the sentences, in code points: pieces between white space that follows an end mark; null for null."""
    gap = r"(?<=[.!?])\s+"
    pieces, gaps = F.split(text, gap), F.regexp_extract_all(text, F.lit(f"({gap})"), F.lit(1))
    sizes = F.zip_with(pieces, gaps, lambda p, g: F.struct(F.length(p).alias("body"), F.coalesce(F.length(g), F.lit(0)).alias("gap")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, size: Column) -> Column:
        end = state["at"] + size["body"]
        span = F.struct(state["at"].alias("start"), end.alias("end"))
        return F.struct((end + size["gap"]).alias("at"), F.when(size["body"] > 0, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(sizes, empty, step, lambda s: s["spans"])


def span_around(spans: Column, start: Column, end: Column) -> Column:
    """The first of ``spans`` that holds start..end whole; null if none does or the span is empty."""
    return F.when(end > start, F.get(F.filter(spans, lambda s: (s["start"] <= start) & (s["end"] >= end)), F.lit(0)))


def common_run(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays, row by row of the table over ``b``."""
    zero = F.transform(F.array_prepend(b, F.lit("")), lambda _: F.lit(0))

    def row(above: Column, word: Column) -> Column:
        start = F.array(F.lit(0))
        cells = F.zip_with(F.sequence(F.lit(1), F.size(b)), b, lambda j, w: F.struct(j.alias("j"), (w == word).alias("same")))
        cell = lambda left, c: F.when(c["same"], F.get(above, c["j"] - 1) + 1).otherwise(F.greatest(F.get(above, c["j"]), F.element_at(left, -1)))
        return F.aggregate(cells, start, lambda left, c: F.array_append(left, cell(left, c)))

    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(F.element_at(F.aggregate(a, zero, row), -1))


def rouge_l(reference: Column, candidate: Column) -> Column:
    """F1 of the longest common subsequence of case-folded words."""
    words = lambda t: F.filter(F.split(casefold(t), r"\s+"), lambda w: w != "")
    r, c = words(reference), words(candidate)
    return F.coalesce(F.try_divide(2.0 * common_run(r, c), (F.size(r) + F.size(c)).cast("double")), F.lit(0.0))


def entity_list(text: Column) -> Column:
    """The strings of a JSON array in a reply, fenced or not, trimmed, each once; empty where there is none."""
    inner = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    return F.coalesce(ordered_distinct(F.array_compact(F.from_json(inner, "array<string>"))), F.array().cast("array<string>"))


def answer_tokens(text: Column) -> Column:
    return F.filter(F.split(answer_form(text), " "), lambda t: t != "")


def f1_tokens(p: Column, g: Column) -> Column:
    """Token F1 of two arrays of answer_tokens, repeats counted. The arrays should be columns of their own: each is read once a token."""
    count = lambda a, t: F.size(F.filter(a, lambda x: x == t))
    common = F.aggregate(F.array_distinct(p), F.lit(0), lambda s, t: s + F.least(count(p, t), count(g, t)))
    same = (F.size(p) == 0) & (F.size(g) == 0)
    return F.when(same, 1.0).otherwise(F.coalesce(F.try_divide(2.0 * common, (F.size(p) + F.size(g)).cast("double")), F.lit(0.0)))
