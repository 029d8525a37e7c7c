"""Question benchmarks in raw JSON: validation, parsing into one schema, and joins of raw rows with what was made of them.

Raw rows differ in shape from export to export, so they are read as VARIANT and asked for what they hold; only the search for support
sentences, which needs an HTML parser, runs in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fusemill.functions import articles
from fusemill.functions.text import question_id
from fusemill.operators.support import STOP_WORDS

ITEM = ["question_id", "question", "gold_answers", "dataset_source", "gold_support_sentences", "gold_support_titles", "gold_support_sent_ids", "dataset_version"]


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """One column ``v`` a record: lines of ``.jsonl`` (blank and malformed ones skipped), a list or its ``data`` of ``.json``; other suffixes fail."""
    if path.endswith(".jsonl"):
        return spark.read.text(path).where(F.trim("value") != "").select(F.try_parse_json("value").alias("v")).where(F.col("v").isNotNull())
    if not path.endswith(".json"):
        raise ValueError(f"neither .json nor .jsonl: {path}")
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    listed = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.try_variant_get("v", "$.data", "array<variant>"))
    return whole.select(F.explode(listed).alias("v"))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _filled(text: Column) -> Column:
    """The trimmed text, null if nothing is left."""
    return F.nullif(_strip(text), F.lit(""))


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _text(v: Column, path: str) -> Column:
    """The scalar at ``path`` as text."""
    return F.when(~_kind(v, path).rlike("^(OBJECT|ARRAY)"), F.try_variant_get(v, path, "string"))


def _listed(v: Column) -> Column:
    """A list as it is, one object as a list of it."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(F.schema_of_variant(v).startswith("OBJECT"), F.array(v)), F.array().cast("array<variant>"))


def _texts(v: Column) -> Column:
    """Trimmed texts of a scalar or a list of scalars, without empty ones."""
    many = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.try_variant_get(x, "$", "string"))
    one = F.array(F.when(~F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)"), F.try_variant_get(v, "$", "string")))
    return F.filter(F.transform(F.coalesce(many, one), _strip), lambda x: x.isNotNull() & (x != ""))


def nq_question(v: Column) -> Column:
    return F.coalesce(*[_filled(_text(v, p)) for p in ("$.question.text", "$.question_text", "$.questionText", "$.question")])


def nq_title(v: Column) -> Column:
    return F.coalesce(*[_filled(_text(v, p)) for p in ("$.document.title", "$.document_title", "$.title")], F.lit(""))


def nq_entries(v: Column) -> Column:
    """All short answers of all annotations, as variants."""
    short = lambda a: _listed(F.coalesce(F.try_variant_get(a, "$.short_answers", "variant"), F.parse_json(F.lit("[]"))))
    return F.flatten(F.transform(_listed(F.coalesce(F.try_variant_get(v, "$.annotations", "variant"), F.parse_json(F.lit("[]")))), short))


def _index(e: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(e, f"$.{name}[0]", "int"), F.try_variant_get(e, f"$.{name}", "int"))


def _entry_texts(e: Column) -> Column:
    none = F.array().cast("array<string>")
    own = F.coalesce(_texts(F.try_variant_get(e, "$.text", "variant")), none)
    return F.when(F.schema_of_variant(e).startswith("OBJECT"), own).otherwise(F.coalesce(_texts(e), none))


def nq_answers(entries: Column, token: Column, is_html: Column) -> Column:
    """Distinct short answers in order: an entry's texts, else its span's visible tokens (both ends included)."""

    def spanned(e: Column) -> Column:
        first, last = _index(e, "start_token"), _index(e, "end_token")
        inside = (first >= 0) & (first <= last) & (last < F.least(F.size(token), F.size(is_html)))
        seen = F.transform(F.sequence(first, last), lambda i: F.when(~F.coalesce(F.get(is_html, i), F.lit(False)), _filled(F.get(token, i))))
        return F.when(F.coalesce(inside, F.lit(False)), F.array(F.array_join(F.filter(seen, lambda t: t.isNotNull()), " ")))

    each = F.transform(entries, lambda e: F.when(F.size(_entry_texts(e)) > 0, _entry_texts(e)).otherwise(F.coalesce(spanned(e), F.array().cast("array<string>"))))
    return F.array_distinct(F.filter(F.flatten(each), lambda x: x != ""))


def nq_has_context(v: Column) -> Column:
    """Whether a row holds html, a visible token, or an older export's text."""
    token, is_html = F.try_variant_get(v, "$.document.tokens.token", "array<string>"), F.try_variant_get(v, "$.document.tokens.is_html", "array<boolean>")
    seen = F.exists(F.arrays_zip(token.alias("t"), is_html.alias("h")), lambda x: (~x["h"]) & (_strip(x["t"]) != ""))
    listed = F.exists(F.try_variant_get(v, "$.document.tokens", "array<variant>"), lambda t: (F.coalesce(F.try_variant_get(t, "$.token", "string"), F.lit("")) != "") & ~F.coalesce(F.try_variant_get(t, "$.is_html", "boolean"), F.lit(False)))
    older = [_filled(_text(v, p)).isNotNull() for p in ("$.document.html", "$.context", "$.document_text", "$.document", "$.paragraph", "$.document_html")]
    out = F.coalesce(seen, F.lit(False)) | F.coalesce(listed, F.lit(False))
    for o in older:
        out = out | o
    return out


def nq_parsed(records: DataFrame) -> DataFrame:
    """v, question, title, html, token, is_html, entries, gold_answers, has_context, fail_reasons of raw rows."""
    v = F.col("v")
    html = F.coalesce(_filled(_text(v, "$.document.html")), _filled(_text(v, "$.document_html")))
    token, is_html = F.try_variant_get(v, "$.document.tokens.token", "array<string>"), F.try_variant_get(v, "$.document.tokens.is_html", "array<boolean>")
    out = records.select("v", nq_question(v).alias("question"), nq_title(v).alias("title"), html.alias("html"), token.alias("token"), is_html.alias("is_html"), nq_entries(v).alias("entries"), nq_has_context(v).alias("has_context"))
    out = out.withColumn("gold_answers", nq_answers(F.col("entries"), F.col("token"), F.col("is_html")))
    lacks = [("question", F.col("question").isNull()), ("short answers", F.size("gold_answers") == 0), ("document context", ~F.col("has_context"))]
    return out.withColumn("fail_reasons", F.array_compact(F.array(*[F.when(c, F.lit(f"missing {name}")) for name, c in lacks])))


_WORD = re.compile(r"\w+")


def _terms(text: str) -> set[str]:
    return {w for w in _WORD.findall(text.lower()) if w not in STOP_WORDS and len(w) > 1}


def _form(text: str) -> str:
    out = re.sub(r"\s+([,.;:!?%])", r"\1", text.casefold().replace("|", " "))
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", out)).strip()


def context_terms(token: Sequence[str], is_html: Sequence[bool], first: int, last: int, window: int = 20) -> set[str]:
    """Keywords of the visible tokens within ``window`` tokens of a span."""
    near = range(max(0, first - window), min(len(token), len(is_html), last + window + 1))
    bare = {re.sub(r"[^\w]+", "", str(token[i]).strip()).lower() for i in near if not is_html[i]}
    return {t for t in bare if len(t) > 1 and t not in STOP_WORDS}


def question_phrases(question: str) -> list[str]:
    """Distinct pairs of keywords that follow each other."""
    words = [w for w in _WORD.findall(question.lower()) if w not in STOP_WORDS and len(w) > 1]
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def trimmed(sentence: str, answers: Sequence[str], question: str, long: int = 250) -> str:
    """A long sentence from the last pair of question words before the answer on; others as they are."""
    folded = sentence.casefold()
    if len(sentence) < long:
        return sentence
    whole = [a.casefold().strip() for a in sorted(answers, key=len, reverse=True)]
    at = next((folded.find(a) for a in whole if a and a in folded), -1)
    if at < 0:
        at = min((folded.find(w.casefold()) for a in answers for w in _WORD.findall(a) if len(w) > 3 and w.casefold() in folded), default=-1)
    places = [p for p in map(folded.find, question_phrases(question)) if 0 <= p <= at]
    return (sentence[max(places) :].strip(" |-\n\t") if places else "") or sentence


def best_cleaned(candidates: Sequence[str], answers: Sequence[str], context: set[str], question: str) -> str | None:
    """Of the sentences that hold an answer, the first of those that share most with the context, then the question, then are shortest; trimmed."""
    wanted = [f for a in answers if (f := _form(a))]
    fit = [c for c in candidates if any(w in _form(c) for w in wanted)]
    asked = _terms(question)
    best = max(fit, key=lambda s: (len(_terms(s) & context), len(_terms(s) & asked), -len(s)), default=None)
    return best and trimmed(best, answers, question)


def cleaned_sentences(html: str | None) -> list[str]:
    """Distinct sentences of the cleaned article."""
    return list(dict.fromkeys(s for b in articles.blocks_of(html) for s in articles.sentence_list(b.text)))


def support_sentences(html: str | None, question: str, token: Sequence[str], is_html: Sequence[bool], spans: Sequence[tuple[int, int, Sequence[str]]]) -> list[str]:
    """For each short answer the cleaned article's sentence that supports it best; distinct, in order."""
    if not spans or not html:
        return []
    n = min(len(token), len(is_html))
    shown = {i: t for i in range(n) if not is_html[i] and (t := str(token[i]).strip())}
    candidates, out = cleaned_sentences(html), []
    for first, last, texts in spans:
        inside = [shown[i] for i in range(first, min(last, n - 1) + 1) if i in shown]
        if inside:
            found = best_cleaned(candidates, [*texts, " ".join(inside)], context_terms(token, is_html, first, last), question)
            out += [found] if found else []
    return list(dict.fromkeys(out))


def _support(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    for cols in batches:
        out = []
        for html, question, token, is_html, spans in zip(*cols, strict=True):
            listed = [(s["first"], s["last"], list(s["texts"])) for s in (spans if spans is not None else [])]
            fit = token is not None and is_html is not None
            out.append(support_sentences(html, question or "", list(token), list(is_html), listed) if fit else [])
        yield pd.Series(out, dtype=object)


def load_nq(records: DataFrame, version: str | None = None) -> DataFrame:
    """Benchmark items of raw rows; rows that lack a question, an answer, a document or a support sentence go."""
    ok = nq_parsed(records).where(F.size("fail_reasons") == 0)
    span = lambda e: F.struct(_index(e, "start_token").alias("first"), _index(e, "end_token").alias("last"), F.array_distinct(_entry_texts(e)).alias("texts"))
    spans = F.filter(F.transform(F.filter("entries", lambda e: F.schema_of_variant(e).startswith("OBJECT")), span), lambda s: F.coalesce((s["first"] >= 0) & (s["last"] >= s["first"]), F.lit(False)))
    made = ok.withColumn("gold_support_sentences", F.pandas_udf(_support, "array<string>")("html", "question", "token", "is_html", spans)).where(F.size("gold_support_sentences") > 0)
    each = lambda value: F.transform("gold_support_sentences", lambda _: value)
    return made.withColumns(
        {
            "question_id": question_id(F.col("question")),
            "dataset_source": F.lit("nq"),
            "gold_support_titles": each(F.col("title")),
            "gold_support_sent_ids": each(F.lit(-1)),
            "dataset_version": F.lit(version).cast("string"),
        }
    ).select(*ITEM)


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once: what a lambda takes from outside is computed anew for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def support_lines(v: Column) -> Column:
    """Array of (title, sent_id, sentence): each supporting fact in the first article of its title that has the sentence; each sentence once."""
    titles = F.transform(F.try_variant_get(v, "$.supporting_facts.title", "array<variant>"), lambda x: F.trim(F.try_variant_get(x, "$", "string")))
    ids = F.transform(F.try_variant_get(v, "$.supporting_facts.sent_id", "array<variant>"), lambda x: F.try_variant_get(x, "$", "int"))
    there = F.transform(F.try_variant_get(v, "$.context.title", "array<variant>"), lambda x: F.trim(F.try_variant_get(x, "$", "string")))
    bodies = F.transform(F.try_variant_get(v, "$.context.sentences", "array<variant>"), lambda x: F.try_variant_get(x, "$", "array<string>"))
    facts = F.zip_with(titles, ids, lambda t, i: F.struct(t.alias("title"), i.alias("sent_id")))

    def line(f: Column, articles_: Column) -> Column:
        held = F.transform(articles_, lambda a: F.when((a["title"] == f["title"]) & (f["sent_id"] >= 0), _filled(F.get(a["body"], f["sent_id"]))))
        return F.struct(f["title"].alias("title"), f["sent_id"].alias("sent_id"), F.get(F.filter(held, lambda s: s.isNotNull()), F.lit(0)).alias("sentence"))

    context = F.zip_with(there, bodies, lambda t, b: F.struct(t.alias("title"), b.alias("body")))
    found = F.filter(_once(context, lambda c: F.transform(facts, lambda f: line(f, c))), lambda x: (x["title"] != "") & x["sentence"].isNotNull())

    def distinct(lines: Column) -> Column:
        return _once(F.transform(lines, lambda x: x["sentence"]), lambda spelled: F.filter(lines, lambda x, k: F.array_position(spelled, x["sentence"]) == k + 1))

    return F.coalesce(_once(found, distinct), F.array().cast("array<struct<title:string,sent_id:int,sentence:string>>"))


def load_multihop(records: DataFrame, source: str, version: str | None = None, strip_question: bool = True) -> DataFrame:
    """Benchmark items of rows with context and supporting_facts; rows that lack a question, an answer or a supporting sentence go."""
    v = F.col("v")
    asked = F.try_variant_get(v, "$.question", "string")
    made = F.struct((_strip(asked) if strip_question else asked).alias("question"), _texts(F.try_variant_get(v, "$.answer", "variant")).alias("gold_answers"), support_lines(v).alias("lines"))
    made = records.select(F.explode(F.array(made)).alias("r")).select("r.*")  # no filter is pushed below a generator, so nothing is parsed for it once more
    made = made.where((F.coalesce("question", F.lit("")) != "") & (F.size("gold_answers") > 0) & (F.size("lines") > 0))
    return made.withColumns(
        {
            "question_id": question_id(F.col("question")),
            "dataset_source": F.lit(source),
            "gold_support_sentences": F.col("lines.sentence"),
            "gold_support_titles": F.col("lines.title"),
            "gold_support_sent_ids": F.col("lines.sent_id"),
            "dataset_version": F.lit(version).cast("string"),
        }
    ).select(*ITEM)


def samples(raw: DataFrame, items: DataFrame, multihop: Sequence[str] = ("2wiki", "hotpotqa")) -> DataFrame:
    """Raw rows whose question a benchmark of their source has; rows of multi-hop sources need supporting facts. raw: dataset_source, v."""
    keyed = raw.withColumn("question_id", question_id(nq_question(F.col("v"))))
    whole = ~F.col("dataset_source").isin(list(multihop)) | F.try_variant_get("v", "$.supporting_facts", "variant").isNotNull()
    return keyed.where(F.coalesce(whole, F.lit(False))).join(items.select("dataset_source", "question_id").distinct(), ["dataset_source", "question_id"])


def raw_paths(items: DataFrame, paths: Mapping[str, str]) -> DataFrame:
    """dataset_source and its path, null where none is known."""
    known = items.sparkSession.createDataFrame(list(paths.items()) or [(None, None)], "dataset_source string, path string").where("dataset_source IS NOT NULL")
    return items.select("dataset_source").where("dataset_source IS NOT NULL").distinct().join(known, "dataset_source", "left")


def article_key(html: Column, title: Column, fallback: Column) -> Column:
    """Key of a raw article: hash of its html, else title, else id."""
    return F.sha2(F.coalesce(_filled(html), _filled(title), fallback.cast("string")), 256)


def supporting_titles(titles: Column) -> Column:
    """Distinct titles in order, without empty ones."""
    return F.array_distinct(F.filter(F.transform(titles, lambda t: F.trim(t)), lambda t: t != ""))


def supporting_articles(sampled: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Articles of the titles that samples need, once each, and the titles that the store lacks. sampled: titles; store: title and further columns."""
    need = sampled.select(F.explode(supporting_titles(F.col("titles"))).alias("title")).distinct()
    return need.join(store, "title"), need.join(store.select("title").distinct(), "title", "left_anti")
