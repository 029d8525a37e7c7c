"""Entities that a question names: dictionary phrases, filtered, resolved by aliases, ranked; aliases and titles as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fusemill.functions.text import entity_key, query_form
from fusemill.operators import phrases

# Matches that name nothing when they stand alone, and the two-letter ones that do.
STAND_ALONE = """
a an the and or but if in is it of on at to as by no we he be do me my up
was were are for not with from that this when who whom which what how why
her him his has had may out new can did its now one any all our she own too
few per via etc ago two six ten n d place s wh f c or b wha
older earlier later first second third born die died death burial spouse
performer director song country earring burial place which film which song
which country where was where is when did what is who are which is film was
which who what how year years month day date age released release
paternal father mother husband wife spouse born study studied same more recently directors
""".split()
STAND_ALONE_PHRASES = ["place of birth", "place of death", "film was released", "the same"]
TWO_LETTERS = ["us", "uk", "eu", "un", "up"]
#: Where a phrase comes from, the most trusted first.
SOURCES = ["redirect_alias", "curated_alias", "surface", "canonical"]


def spurious(match_key: Column, least: int = 3) -> Column:
    """Keys that are too short or stand for nothing."""
    key, n = F.trim(match_key), F.length(F.trim(match_key))
    known = (n == 2) & key.isin(TWO_LETTERS)
    return (n < 2) | ((n < least) & ~known) | ((n == 2) & ~known) | key.isin(STAND_ALONE + STAND_ALONE_PHRASES)


def aliases(*tables: DataFrame) -> DataFrame:
    """alias, canonical, both as entity keys: of an alias that several tables have, the first table's (and in it the last ``pos``). tables: alias, canonical, pos."""
    out = None
    for k, t in enumerate(tables):
        part = t.select(entity_key(F.col("alias")).alias("alias"), entity_key(F.col("canonical")).alias("canonical"), F.lit(-k).alias("rank"), F.col("pos"))
        out = part if out is None else out.unionByName(part)
    fit = out.where((F.col("alias") != "") & (F.col("canonical") != ""))
    return fit.groupBy("alias").agg(F.max_by("canonical", F.struct("rank", "pos", "canonical")).alias("canonical"))


def redirect_aliases(redirects: DataFrame) -> DataFrame:
    """alias, canonical, pos of redirects to their pages: a redirect of several pages goes to the last by name. redirects: title, redirect."""
    rows = redirects.where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("redirect", F.lit("")) != "")).select("title", "redirect").distinct()
    return rows.select(F.col("redirect").alias("alias"), F.col("title").alias("canonical"), F.struct("title", "redirect").cast("string").alias("pos"))


def lexicon_aliases(lexicon: DataFrame) -> DataFrame:
    """alias, canonical, pos of a lexicon's surface forms. lexicon: norm, surface_forms (array)."""
    return lexicon.select(F.explode("surface_forms").alias("alias"), F.col("norm").alias("canonical"), F.col("norm").alias("pos"))


def surface_forms(raw: Column) -> Column:
    """Surface forms of a text that is one form or a bracketed list of quoted ones."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    listed = F.from_json(F.regexp_replace(text, r"(?<=[\[,]\s{0,9})'([^']*)'(?=\s*[,\]])", '"$1"'), "array<string>")
    return F.when(text == "", F.array().cast("array<string>")).when(text.rlike(r"^\[.*\]$"), F.coalesce(listed, F.array(text))).otherwise(F.array(text))


def lexicon(mentions: DataFrame, most: int = 5) -> DataFrame:
    """norm, surface, n, df: the ``most`` most frequent surface forms of each norm (equal ones by text), and in how many chunks the norm stands.

    mentions: norm, surface, chunk_id. Mentions without a norm or a surface don't count. All is counted before any form is ranked, so a frequent norm costs a
    row a form.
    """
    named = mentions.where("norm <> '' AND surface IS NOT NULL")
    counted = named.groupBy("norm", "surface").agg(F.count(F.lit(1)).alias("n"))
    first = counted.withColumn("_r", F.row_number().over(Window.partitionBy("norm").orderBy(F.desc("n"), "surface"))).where(F.col("_r") <= most).drop("_r")
    return first.join(named.groupBy("norm").agg(F.count_distinct("chunk_id").alias("df")), "norm")


def df_map(lexicon: DataFrame) -> DataFrame:
    """norm, df of a lexicon: norms as entity keys, the last ``pos`` of a norm wins, a df that is no number is 0. lexicon: norm, df, pos."""
    rows = lexicon.select(entity_key(F.col("norm")).alias("norm"), F.coalesce(F.col("df").try_cast("int"), F.lit(0)).alias("df"), "pos").where("norm <> ''")
    return rows.groupBy("norm").agg(F.max_by("df", "pos").alias("df"))


def resolved(norms: Column, frame: DataFrame, alias: DataFrame, name: str = "canonical") -> DataFrame:
    """``frame`` with the entity key of ``norms`` under ``name``, by way of its alias where there is one."""
    keyed = frame.withColumn("_key", entity_key(norms))
    joined = keyed.drop(name).join(alias.select(F.col("alias").alias("_alias"), F.col("canonical").alias("_to")), F.col("_key") == F.col("_alias"), "left")
    return joined.withColumn(name, F.coalesce("_to", "_key")).drop("_key", "_alias", "_to")


def resolve_and_filter(found: DataFrame, texts: DataFrame, alias: DataFrame, max_df: int | None = 8, least: int = 3) -> DataFrame:
    """id, start, end, match_key, matched, canonical, df, prio: matches that name something, resolved by their own span, the best of each name.

    found: what phrases.matches gives; texts: id, text (in query form). ``max_df`` None keeps frequent names.
    """
    fit = found.where(~spurious(F.col("match_key"), least))
    fit = fit if max_df is None else fit.where(F.col("df") <= max_df)
    spans = fit.drop("canonical").join(texts.select("id", "text"), "id").withColumn("matched", F.substr("text", F.col("start") + 1, F.col("end") - F.col("start"))).drop("text")
    named = resolved(F.col("matched"), spans, alias).where("canonical <> ''")
    best = F.struct((F.col("start") - F.col("end")).alias("span"), "df", "prio", "start")
    kept = F.min_by(F.struct("start", "end", "match_key", "matched", "df", "prio"), best).alias("m")
    return named.groupBy("id", "canonical").agg(kept).select("id", "canonical", "m.*")


def ranked(entities: DataFrame, most: int = 12) -> DataFrame:
    """The ``most`` entities of each text with their rank from 1: longest span, lowest df, most trusted source, earliest, name."""
    order = [F.desc(F.col("end") - F.col("start")), "df", "prio", "start", "canonical"]
    return entities.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where(F.col("rank") <= most)


def extract(questions: DataFrame, dictionary: DataFrame, alias: DataFrame, max_df: int | None = 8, most: int = 12, least: int = 3) -> DataFrame:
    """id, rank, canonical, matched, start, end, n_tokens, df, prio, match_key of each question's entities; offsets are those of its query form.

    questions: id, text; dictionary: match_key, canonical, df, prio (place of the source in SOURCES); ``max_df`` None gives soft candidates.
    """
    texts = questions.select("id", query_form(F.coalesce("text", F.lit(""))).alias("text"))
    found = phrases.matches(texts, dictionary, "id", "text")
    out = ranked(resolve_and_filter(found, texts, alias, max_df, least), most)
    tokens = F.size(F.filter(F.split("matched", r"\s+"), lambda t: t != ""))
    return out.withColumn("n_tokens", F.greatest(F.lit(1), tokens))


def enrich_seeds(candidates: DataFrame, nodes: DataFrame, near: DataFrame) -> DataFrame:
    """Candidates with node, vector_score and graph_present: their own node, else the nearest node by vector that the graph has.

    candidates: question_id, canonical; nodes: entity; near: canonical, matched, score, the vector search of the names.
    """
    known = nodes.select(F.col("entity").alias("node")).distinct()
    own = candidates.join(known, F.col("canonical") == F.col("node"), "left")
    hits = near.join(known.withColumnRenamed("node", "matched"), "matched", "left_semi")
    best = hits.groupBy("canonical").agg(F.max_by(F.struct("matched", "score"), F.struct("score", "matched")).alias("b"))
    met = own.join(best, "canonical", "left")
    return met.select(
        *[c for c in candidates.columns if c != "canonical"],
        F.when(F.col("node").isNull() & F.col("b").isNotNull(), F.col("b.matched")).otherwise(F.col("canonical")).alias("canonical"),
        F.when(F.col("node").isNull(), F.col("b.score")).alias("vector_score"),
        (F.col("node").isNotNull() | F.col("b").isNotNull()).alias("graph_present"),
        F.coalesce("node", F.col("b.matched")).alias("node"),
    )


def capitalised(text: Column) -> Column:
    """Distinct runs of capitalised words, in order."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\b[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*\b)"), F.lit(1))
    return F.array_distinct(runs)


def title_matches(texts: DataFrame, titles: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, title: titles (column title) that stand in texts as whole words, case folded; longest first, without overlap, each once."""
    folded = F.lower(F.trim("title"))
    words = titles.where(F.trim("title") != "").groupBy(folded.alias("match_key")).agg(F.min("title").alias("canonical")).withColumns({"df": F.lit(1), "prio": F.lit(0)})
    lowered = texts.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text"))
    return phrases.matches(lowered, words, "id", "text").select("id", F.col("canonical").alias("title")).distinct()


def fingerprint(*tables: DataFrame) -> str:
    """A mark of the rows of tables, whatever their order: built artifacts are valid while it stays."""
    marks = [df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*df.columns)), F.sum(F.pmod(F.xxhash64(*df.columns), F.lit(1 << 31)))).first() for df in tables]
    return "-".join(f"{n}.{(x or 0) % (1 << 64):016x}.{s or 0}" for n, x, s in marks)
