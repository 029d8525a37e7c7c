"""Line dedup by a log-template tree.

Lines are parsed to a fixed depth: token count, then ``depth`` leading tokens, lead to a leaf; tokens with a digit are variable
fields from the start. Within a leaf a token that stands at its place in fewer than ``min_docs`` texts is a variable field, too. The
line with its variable fields marked is its template. A template recurs if lines of at least ``min_docs`` documents of different
text have it and at least ``min_constant`` of its tokens are constant. Of a recurring template the first line (smallest document
id, then line number, then hash of the text) stays and all others are dropped; with ``keep_first`` False that one goes as well.

Lines of ``long_tokens`` tokens or more are held to ``long_docs`` documents as well, in place of ``min_docs``: a long passage recurs from its
second text on. Such a line goes if it is a later line by either rule. What it is later than comes before it, so one line of each group stays.

Documents of exactly the same text count once, so that copies alone make nothing recur; they lose lines as one.

Scale: the tree is a grouping by hashes. Leaves that only one text reaches go first, on rows of a few numbers; a leaf with one spelling
needs no tokens. In the others a line is cut into pieces of ``PIECE`` tokens, and a piece that as many texts share as any rule asks is constant
as a whole; only the tokens of the rest are counted one by one, together with those of the constant pieces at their place. A template is the exclusive or of its constant places' hashes, so that
it is a partial aggregate and no line is put together again. Each distinct line is read from one document that holds it.
Documents are counted as distinct texts; a line's least and greatest text stand for all of its texts where it has two at most. No leaf, template or
document group is gathered in one task: all steps are partial aggregates, or joins whose skewed parts AQE may split since a written table follows them;
the list of a document's dropped lines is as long as the document at most.

Defined results: null text stays null, and has no lines; lines with fewer than ``min_tokens`` tokens always stay; null ids order first; rows of the same
id and text lose the same lines; an empty table gives an empty result; texts and lines of any length are taken whole. A text left without lines becomes ''.
Further columns pass under any name; one named n_lines or n_dropped is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fusemill.llm.common import ASCII_SPACE, ROW, boxed, cut, named, unboxed

VARIABLE = "<*>"
#: Tokens of a line that are compared at once before they are compared one by one.
PIECE = 16


def tokens_of(line: Column) -> Column:
    """Tokens of a line; a token with a digit is a variable field."""
    # from the start of a token on, without going back: linear in the line
    masked = F.regexp_replace(line, rf"(?<![^{ASCII_SPACE}])[^{ASCII_SPACE}\d]*+\d[^{ASCII_SPACE}]*+", VARIABLE)
    return F.array_remove(F.split(F.when(line.rlike(r"\d"), masked).otherwise(line), f"[{ASCII_SPACE}]+"), "")


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _leaf(toks: Column, depth: int) -> Column:
    return F.xxhash64(F.size(toks), *[F.get(toks, F.lit(k)) for k in range(depth)])


def _line(toks: Column) -> Column:
    return F.xxhash64(F.array_join(toks, " "))


def _places(docs: DataFrame, id_col: str, text_col: str, depth: int, min_tokens: int) -> DataFrame:
    """id, text (hash), no, leaf, line (hash), n (tokens), c (of them without a digit): the lines of enough tokens."""
    # the second transform takes each line's tokens as one value, so that a line is tokenised once
    lines = F.transform(F.split(named(text_col), "\n"), tokens_of)
    constant = lambda t: F.size(F.filter(t, lambda x: x != VARIABLE))
    rows = F.transform(lines, lambda t: F.struct(_leaf(t, depth).alias("leaf"), _line(t).alias("line"), F.size(t).alias("n"), constant(t).alias("c")))
    made = docs.select(named(id_col).alias("id"), _text_key(named(text_col)).alias("text"), F.posexplode(rows).alias("no", "x"))
    return made.select("id", "text", "no", "x.*").where(F.col("n") >= min_tokens)


def _spelled(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The ``wanted`` lines with their tokens, each read from the one document that its column ``at`` names.

    The whole texts are shuffled once, by document; only wanted lines are parsed again.
    """
    kept = [c for c in wanted.columns if c not in ("at", "text")]
    need = wanted.groupBy(F.col("at.id").alias("need_id"), F.col("text").alias("need_text")).agg(F.collect_list(F.struct("at.no", *kept)).alias("need"))
    whole = named(text_col)
    texts = docs.where(whole.isNotNull()).select(named(id_col).alias("id"), _text_key(whole).alias("text"), whole.alias("whole"))
    met = texts.join(need, F.col("id").eqNullSafe(F.col("need_id")) & (F.col("text") == F.col("need_text")))
    # the split text passes the generator as a column, so that a text is split once
    each = met.select(F.split("whole", "\n").alias("all"), "need").select("all", F.explode("need").alias("n"))
    read = each.select(*[F.col(f"n.{c}") for c in kept], tokens_of(F.get("all", F.col("n.no"))).alias("toks"))
    # rows of the same id and text bring a line more than once
    return read.groupBy("leaf", "line").agg(*[F.first(c).alias(c) for c in (*kept, "toks") if c not in ("leaf", "line")])


def _texts_of(rows: DataFrame, key: str) -> DataFrame:
    """(key, texts): different texts that lines with each value of ``key`` have, up to the number any rule asks. rows: key, docs, few."""
    spread = rows.select(key, "docs", F.explode("few").alias("text"))
    return spread.groupBy(key).agg(F.greatest(F.count_distinct("text"), F.max("docs")).alias("texts"))


def _templates(lines: DataFrame, needs: list[int], min_constant: float) -> DataFrame:
    """leaf, line, docs, few, need, template of the lines that have enough constant tokens. lines: leaf, line, n, docs, few, rules, toks."""
    top = F.array_max("rules")  # no rule that holds in the leaf asks for more texts
    cuts = F.sequence(F.lit(0), F.floor((F.col("n") - 1) / PIECE).cast("int"))
    pieces = F.transform(cuts, lambda k: F.struct(k.alias("k"), F.slice("toks", k * PIECE + 1, F.lit(PIECE)).alias("part")))
    cutup = lines.select("leaf", "line", "docs", "few", top.alias("top"), F.explode(pieces).alias("p"))
    cutup = cut(cutup.select("leaf", "line", "docs", "few", "top", "p.k", "p.part", F.xxhash64("leaf", "p.k", "p.part").alias("piece")))
    met = cut(cutup.join(cut(_texts_of(cutup, "piece")), "piece"))
    slots = F.transform("part", lambda t, i: F.when(t != VARIABLE, F.xxhash64("leaf", F.col("k") * PIECE + i, t)))
    slots = F.filter(slots, lambda s: s.isNotNull())
    joined = F.aggregate(slots, F.lit(0).cast("bigint"), lambda a, s: a.bitwiseXOR(s))
    fine, rest = met.where("texts >= top"), met.where("texts < top")
    whole = fine.select("leaf", "line", F.col("top").alias("texts"), F.size(slots).alias("places"), joined.alias("slot"))
    single = cut(rest.select("leaf", "line", "k", "docs", "few", F.explode(slots).alias("slot")))
    # a token of such a piece may stand in a constant one of another line as well: each of those counts once, with all its texts
    near = fine.groupBy("piece").agg(*[F.first(c).alias(c) for c in ("leaf", "k", "part", "few")], F.max("texts").alias("docs"))
    near = near.join(single.select("leaf", "k").distinct(), ["leaf", "k"], "left_semi")
    places = single.select("slot", "docs", "few").unionByName(near.select(F.explode(slots).alias("slot"), "docs", "few"))
    counted = single.select("leaf", "line", "slot").join(cut(_texts_of(places, "slot")), "slot")
    parts = whole.unionByName(counted.select("leaf", "line", "texts", F.lit(1).alias("places"), "slot"))
    held = lambda need: F.col("texts") >= need
    sums = [F.sum(F.when(held(r), F.col("places")).otherwise(0)).alias(f"places{r}") for r in needs]
    marks = [F.bit_xor(F.when(held(r), F.col("slot")).otherwise(F.lit(0).cast("bigint"))).alias(f"mark{r}") for r in needs]
    by_line = parts.groupBy("leaf", "line").agg(*sums, *marks)
    each = F.array(*[F.struct(F.lit(r).alias("need"), F.col(f"places{r}").alias("places"), F.col(f"mark{r}").alias("mark")) for r in needs])
    spelled = lines.select("leaf", "line", "n", "docs", "few", "rules").join(by_line, ["leaf", "line"])
    spelled = spelled.select("leaf", "line", "n", "docs", "few", "rules", F.explode(each).alias("t"))
    spelled = spelled.where(F.array_contains("rules", F.col("t.need")) & (F.col("t.places") / F.col("n") >= min_constant))
    return spelled.select("leaf", "line", "docs", "few", "t.need", F.xxhash64("leaf", "t.need", "t.mark").alias("template"))


def recurring(
    docs: DataFrame,
    mine: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 3,
    min_constant: float = 0.6,
    long_tokens: int = 50,
    long_docs: int = 2,
) -> DataFrame:
    """leaf, line, template: the hashes of the distinct lines whose template recurs; a long line may have one template of each rule.

    mine: the lines that _places gives, of leaves that two texts or more reach.
    """
    needs = sorted({min_docs, long_docs})
    # documents of one text have a line at the same places, so the smallest of each belong together
    by_text = mine.groupBy("leaf", "line", "text").agg(F.min(F.struct("id", "no")).alias("at"), F.max("n").alias("n"), F.max("c").alias("c"))
    texts = F.count(F.lit(1)).alias("docs"), F.min("text").alias("low"), F.max("text").alias("high"), F.min_by("at", "text").alias("at")
    counted = cut(by_text.groupBy("leaf", "line").agg(*texts, F.max("n").alias("n"), F.max("c").alias("c")))
    leaves = cut(counted.groupBy("leaf").agg(F.sum("docs").alias("of_leaf"), F.count(F.lit(1)).alias("spellings")))
    # a leaf of fewer texts than a rule asks, each counted once a line, holds no template of so many
    asked = [F.when(F.col("of_leaf") >= min_docs, min_docs), F.when((F.col("n") >= long_tokens) & (F.col("of_leaf") >= long_docs), long_docs)]
    lines = counted.join(leaves, "leaf").withColumn("rules", F.array_distinct(F.array_compact(F.array(*asked)))).where(F.size("rules") > 0)
    lines = cut(lines)
    alone = lines.where((F.col("spellings") == 1) & (F.col("docs") >= F.array_min("rules")) & (F.col("c") / F.col("n") >= min_constant))
    several = lines.where("spellings > 1").select("leaf", "line", F.col("low").alias("text"), "at", "n", "docs", "rules", F.array_distinct(F.array("low", "high")).alias("few"))
    if needs[-1] > 3:  # the least and the greatest text aren't all that the rule has to know
        listed = by_text.join(several.where(F.col("docs") < needs[-1]).select("leaf", "line"), ["leaf", "line"], "left_semi")
        listed = listed.groupBy("leaf", "line").agg(F.collect_list("text").alias("listed"))
        several = several.join(listed, ["leaf", "line"], "left").withColumn("few", F.coalesce("listed", "few")).drop("listed")
    spelled = cut(_spelled(docs, several, id_col, text_col))
    made = cut(_templates(spelled, needs, min_constant))
    enough = cut(_texts_of(made, "template"))
    found = made.join(enough, "template").where(F.col("texts") >= F.col("need")).select("leaf", "line", "template")
    return found.union(alone.select("leaf", "line", F.xxhash64("leaf", "line").alias("template")))


def dropped_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, min_tokens: int = 4, keep_first: bool = True, **limits
) -> DataFrame:
    """id, text (hash), drop: the line numbers (from 0) that a document loses, for the documents that lose any."""
    places = cut(_places(docs, id_col, text_col, depth, min_tokens))
    shared = cut(places.groupBy("leaf").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a < b").select("leaf"))
    mine = cut(places.join(shared, "leaf", "left_semi"))
    again = cut(recurring(docs, mine, id_col, text_col, **limits))
    seen = cut(mine.join(again, ["leaf", "line"]).select("id", "text", "no", "template"))
    if keep_first:
        first = cut(seen.groupBy("template").agg(F.min(F.struct("id", "no", "text")).alias("first")))
        seen = seen.join(first, "template").where(~F.struct("id", "no", "text").eqNullSafe(F.col("first")))
    return seen.groupBy("id", "text").agg(F.collect_set("no").alias("drop"))


def _freed(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """The boxed rows with drop, text (without the dropped lines), n_lines and n_dropped."""
    drop = dropped_lines(docs, id_col, text_col, **options).withColumnsRenamed({"id": "drop_id", "text": "drop_text"})
    keyed = docs.select(boxed(docs), named(id_col).alias("id"), _text_key(named(text_col)).alias("key"))
    joined = keyed.join(drop, F.col("id").eqNullSafe(F.col("drop_id")) & (F.col("key") == F.col("drop_text")), "left")
    whole = F.col(ROW).getField(text_col)
    joined = joined.select(ROW, "drop", F.split(whole, "\n").alias("all"))
    n_lines = F.when(F.col("all").isNull(), 0).otherwise(F.size("all"))
    n_dropped = F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop"))
    left = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), "drop")
    text = F.when(F.col("drop").isNull(), whole).otherwise(F.array_join(F.transform(left, lambda i: F.get("all", i)), "\n"))
    return joined.select(ROW, "drop", text.alias("text"), n_lines.cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"))


def _renewed(docs: DataFrame, text_col: str) -> dict[str, Column]:
    made = {text_col: F.col("text")}
    for c in docs.columns:
        if c.lower() == "n_chars" and c != text_col:
            made[c] = F.when(F.col("drop").isNull(), F.col(ROW).getField(c)).otherwise(F.length("text")).cast(docs.schema[c].dataType)
    return made


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Input columns with the text freed from recurring lines (n_chars, where there is one, is renewed), plus n_lines and n_dropped."""
    counts = {"n_lines": F.col("n_lines"), "n_dropped": F.col("n_dropped")}
    return unboxed(_freed(docs, id_col, text_col, **options), docs.columns, **_renewed(docs, text_col), **counts)


def freed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input columns alone, with the text freed from recurring lines and n_chars, where there is one, renewed."""
    return unboxed(_freed(docs, id_col, text_col, **options), docs.columns, **_renewed(docs, text_col))
