"""Quality rules: line-first cleaning.

Every line is held against punctuation, navigation and boilerplate rules; failing lines go, and a document
that loses too much of its text that way is rejected. Base statistics of the whole text reject on their own.
DataFrame functions only; a narrow transformation (no shuffle), so it costs one scan at any size.

Defined results: null text counts as empty (all counts 0, base_failed true, kept false, clean text ''); a
null doc_id is kept as it is; repeated rows are judged alike and all returned; an empty table gives an empty
result; further columns of the input pass through ``clean`` untouched, and a column of the input that has the name
of an added one is replaced. Texts of any length are judged whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fusemill.llm.common import ASCII_SPACE, boxed, named, unboxed, words_of

# Phrases of site furniture, not prose, in English, German, French and Spanish; a dot stands for an accented letter.
PHRASES = {
    "en": "cookies?|privacy policy|terms of (use|service)|javascript|sign (in|up)|log ?in|subscribe|newsletter|click here|read more|share (this|on)|follow us|skip to|back to top|lorem ipsum"
    "|all rights reserved",
    "de": "datenschutz(erkl.rung|hinweise)?|nutzungsbedingungen|impressum|alle rechte vorbehalten|hier klicken|weiterlesen|mehr lesen|jetzt (anmelden|registrieren)|folgen sie uns|folge uns"
    "|nach oben|zum (haupt)?inhalt springen|seite teilen",
    "fr": "politique de confidentialit.|mentions l.gales|tous droits r.serv.s|conditions (g.n.rales|d.utilisation)|cliquez ici|lire la suite|se connecter|s.inscrire|abonnez-vous|suivez-nous|haut de page"
    "|aller au contenu|partager sur",
    "es": "pol.tica de privacidad|aviso legal|todos los derechos reservados|(t.rminos|condiciones) de uso|haga clic|haz clic|leer m.s|iniciar sesi.n|reg.strate|suscr.bete|suscribirse|s.guenos|volver arriba"
    "|saltar al contenido|compartir en",
}
#: Lines with one of these are site furniture.
BOILERPLATE = r"(?i)\b(" + "|".join(PHRASES.values()) + r")(?:[^\p{L}\p{N}_]|$)"
#: A separator between menu entries.
NAV_SEPARATOR = r"(?:^|\s)[|»›•·](?=\s|$)"
TERMINAL = r"[.!?…:;。！？][\"'”’»)\]*]*\s*$"

#: What a line must hold for the counting rules to matter.
SUSPECT = r"[#*$%&|<>»›•·]|!!"
SYMBOL = r"[#*$%&|<>]"

_INDEX_BITS = 24
_INDEX_MASK = (1 << _INDEX_BITS) - 1


def _count(text: Column, pattern: str) -> Column:
    """Matches of ``pattern``; the many texts without any are told by a scan that gathers nothing."""
    return F.when(text.rlike(pattern), F.regexp_count(text, F.lit(pattern))).otherwise(F.lit(0))


def _covered(starts: Column) -> Column:
    """Number of positions that windows of three words at the sorted ``starts`` cover."""
    zero = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        starts,
        zero,
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3).cast("long"), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )


def _twins(values: Column, same) -> Column:
    """Elements of a sorted array that equal a neighbour under ``same(a, b)``."""
    n = F.size(values)
    return F.filter(
        values,
        lambda x, k: ((k > 0) & same(F.get(values, k - 1), x)) | ((k < n - 1) & same(F.get(values, k + 1), x)),
    )


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    return unboxed(_counted(docs, text_col), docs.columns, **{c: F.col(c) for c in COUNTS})


def _counted(docs: DataFrame, text_col: str) -> DataFrame:
    """The boxed rows with their text and the counts.

    n_repeat_words: windows of three words are hashed and packed with their place into one long, so that a
    primitive sort brings equal windows together; equal hash parts of unequal words are detected, and such a
    text is counted by sorting the windows themselves. A text of over 2**24 words goes that way, too.
    """
    text = F.col("whole")
    df = docs.select(boxed(docs), F.coalesce(named(text_col), F.lit("")).alias("whole")).withColumn("_words", words_of(text, ASCII_SPACE))
    w, n = F.col("_words"), F.size("_words")
    window = lambda i: (F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    none = F.array().cast("array<bigint>")
    places = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit("\x20\x09\x0a\x0b\x0c\x0d")) != "")
    df = df.withColumns({"_hashes": F.transform(places, lambda i: F.xxhash64(*window(i))), "_lines": lines})

    # most texts repeat no window and need no sorting
    packed = F.transform(
        "_hashes",
        lambda h, i: F.coalesce(
            h.bitwiseAND(F.lit(~_INDEX_MASK)).bitwiseOR(i.cast("long").bitwiseAND(F.lit(_INDEX_MASK))), F.lit(0).cast("long")
        ),
    )
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    df = df.withColumn("_packed", F.when(repeats, F.sort_array(packed)).otherwise(none))

    head = lambda x: F.shiftright(x, _INDEX_BITS)
    place = lambda x: x.bitwiseAND(F.lit(_INDEX_MASK)).cast("int")
    df = df.withColumn("_twins", _twins(F.col("_packed"), lambda a, b: head(a) == head(b)))
    t = F.col("_twins")
    clash = F.exists(
        F.sequence(F.lit(1), F.size(t) - 1),
        lambda k: (head(F.get(t, k)) == head(F.get(t, k - 1)))
        & (F.struct(*window(place(F.get(t, k)))) != F.struct(*window(place(F.get(t, k - 1))))),
    )
    fast = _covered(F.sort_array(F.transform(t, lambda x: x.bitwiseAND(F.lit(_INDEX_MASK)))))
    spelled = F.sort_array(
        F.transform(places, lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("s"), i.cast("long").alias("i")))
    )
    df = df.withColumn(
        "_spelled",
        F.when((n > _INDEX_MASK) | ((F.size(t) > 1) & clash), spelled),
    )
    slow = _covered(F.sort_array(F.transform(_twins(F.col("_spelled"), lambda a, b: a["s"] == b["s"]), lambda x: x["i"])))
    repeat = F.when(F.col("_spelled").isNotNull(), slow).when(F.size(t) > 0, fast).otherwise(F.lit(0)).cast("long")
    out = df.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": _count(text, SYMBOL).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": repeat,
        }
    ).drop("_words", "_hashes", "_packed", "_lines", "_twins", "_spelled")
    return out.withColumn(
        "base_failed",
        (F.col("n_words") < 50) | (F.lit(100).cast("long") * F.col("n_repeat_words") > F.lit(50).cast("long") * F.col("n_words")),
    )


def line_fails(line: Column) -> Column:
    """True for a line that fails the navigation, boilerplate or punctuation rule; blank lines pass.

    Navigation: three or more menu separators. Boilerplate: a phrase of BOILERPLATE in a line of under 200
    characters. Punctuation: symbols are over a tenth of the characters, or shouted end marks (``!!``) follow
    a third of the words and at least 3, or the line has under 4 words, under 200 characters and no end mark.
    Each text is decoded for as few expressions as can be: SUSPECT tells the lines that need counting.
    """
    navigation = F.regexp_count(line, F.lit(NAV_SEPARATOR)) >= 3
    symbols = F.regexp_count(line, F.lit(SYMBOL)) * 10 > F.length(line)
    shouts = F.regexp_count(line, F.lit("!!"))
    shouted = (shouts >= 3) & (shouts * 3 >= F.regexp_count(line, F.lit(r"\S+")))
    stub = line.rlike(r"^\s*+\S++(\s++\S++){0,2}\s*$") & ~line.rlike(TERMINAL)
    return ((F.length(line) < 200) & (stub | line.rlike(BOILERPLATE))) | (line.rlike(SUSPECT) & (navigation | symbols | shouted))


def clean(docs: DataFrame, text_col: str = "text", max_loss: float = 0.4) -> DataFrame:
    """Input columns plus the counts of ``with_counts``, clean_text, lost_chars, loss and kept.

    kept: not base_failed, and lines failing their rules or repeating an earlier line hold at most ``max_loss``
    of the characters of the text. clean_text is the text without the failing lines (repeats stay: dropping
    them is the work of a deduplicating stage).
    """
    made = {c: F.col(c) for c in (*COUNTS, "clean_text", "lost_chars", "loss", "kept")}
    return unboxed(_cleaned(docs, text_col, max_loss), docs.columns, **made)


def _cleaned(docs: DataFrame, text_col: str, max_loss: float = 0.4) -> DataFrame:
    """The boxed rows with all that ``clean`` adds."""
    df = _counted(docs, text_col)
    lines = F.split("whole", "\n")
    good = F.filter(lines, lambda x: ~line_fails(x))
    df = df.withColumns({"_all": lines, "_good": good})
    chars = lambda c: F.length(F.array_join(c, ""))
    df = df.withColumns(
        {
            "clean_text": F.array_join("_good", "\n"),
            "lost_chars": (chars(F.col("_all")) - chars(F.when(F.col("n_dup_lines") > 0, F.array_distinct("_good")).otherwise(F.col("_good")))).cast("long"),
        }
    )
    df = df.withColumn("loss", F.coalesce(F.try_divide(F.col("lost_chars").cast("double"), F.length("whole").cast("double")), F.lit(0.0)))
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("loss") <= max_loss)).drop("_all", "_good")


def keep(docs: DataFrame, text_col: str = "text", **limits: float) -> DataFrame:
    """The documents that pass, with their failing lines removed, in the columns of ``docs``.

    A column n_chars, where there is one, gets the new length.
    """
    # the id column keeps the filter above the projections, which it would otherwise repeat inside itself
    out = _cleaned(docs, text_col, **limits).withColumn("_row", F.monotonically_increasing_id())
    out = out.where(F.col("kept") & (F.col("_row") >= 0))
    made = {text_col: F.col("clean_text")}
    made |= {c: F.length("clean_text").cast(docs.schema[c].dataType) for c in docs.columns if c.lower() == "n_chars" and c != text_col}
    return unboxed(out, docs.columns, **made)
