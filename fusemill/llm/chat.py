"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and only that reply trainable. Turns
after the last reply (or all, if there is none) make one example without a target, so that nothing is lost.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Texts and roles are escaped reversibly: a backslash is doubled, and in
each control string a backslash follows the first character. A line feed in a role, which would end it, stands as ``LINE_FEED``: escaped text never
holds that string, so nothing else reads back as one.

Defined results: null text or role counts as empty; turns are in the order of turn, nulls first, then role and text; a row of a null conv_id
is a conversation of its own (with rows that repeat it), so that such rows are no group; repeated rows are turns of their own; an empty table gives an
empty result; further columns don't matter, whatever their names. Texts are formatted whole. A conversation is put together in one row, as its examples
and hashes need; its size is the data's.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
LINE_FEED = "<|n|>"
#: Strings that a text must not hold as they are: this template's and those of other common ones.
CONTROL = ("<|", "|>", "[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    out = text
    for c in reversed(CONTROL):
        out = F.replace(out, F.lit(c[0] + "\\" + c[1:]), F.lit(c))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit("\n"), turn["text"], F.lit(END))


def examples(turns: DataFrame, trainable_role: str = "assistant") -> DataFrame:
    """conv_id, own (what tells conversations of a null id apart), example (from 0), is_last, n_turns, formatted, loss_start, loss_chars.

    formatted: the rendered turns up to and with the reply; loss_start (from 0) and loss_chars (code points): the
    escaped reply in it, or null where the example has none.
    """
    turn = F.struct(
        F.col("turn"),
        F.replace(escape(F.col("role")), F.lit("\n"), F.lit(LINE_FEED)).alias("role"),
        escape(F.col("text")).alias("text"),
        (F.coalesce(F.col("role"), F.lit("")) == trainable_role).alias("train"),
    )
    own = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")).alias("own")
    convs = turns.groupBy("conv_id", own).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    convs = convs.withColumn("parts", F.transform("turns", _rendered))
    n = F.size("turns")
    replies = F.filter(F.sequence(F.lit(1), n), lambda k: F.get("turns", k - 1)["train"])
    convs = convs.withColumn("replies", replies)
    tail = F.when(F.coalesce(F.array_max("replies"), F.lit(0)) < n, F.array(n)).otherwise(F.array().cast("array<int>"))
    convs = convs.withColumn("ends", F.concat("replies", tail))
    ex = convs.select("conv_id", "own", "turns", "parts", F.size("ends").alias("n_ex"), F.posexplode("ends").alias("example", "n_turns"))
    last = F.get("turns", F.col("n_turns") - 1)
    ex = ex.withColumns({"formatted": F.array_join(F.slice("parts", F.lit(1), F.col("n_turns")), ""), "_train": last["train"], "_reply": last["text"]})
    chars = F.length("_reply")
    return ex.select(
        "conv_id",
        "own",
        "example",
        (F.col("example") == F.col("n_ex") - 1).alias("is_last"),
        "n_turns",
        "formatted",
        F.when(F.col("_train"), F.length("formatted") - len(END) - chars).alias("loss_start"),
        F.when(F.col("_train"), chars).alias("loss_chars"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted example."""
    bodies = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b, i: i > 0)
    return F.transform(
        bodies,
        lambda b: F.struct(
            unescape(F.replace(F.substring_index(b, "\n", 1), F.lit(LINE_FEED), F.lit("\n"))).alias("role"),
            unescape(F.substr(b, F.length(F.substring_index(b, "\n", 1)) + 2, F.length(b) - F.length(F.substring_index(b, "\n", 1)) - 1 - len(END))).alias("text"),
        ),
    )


def loss_text(formatted: Column, start: Column, chars: Column) -> Column:
    """The text under the loss mask, unescaped; null where there is none."""
    return unescape(F.substr(formatted, start + 1, chars))


def summary(ex: DataFrame) -> DataFrame:
    """One row for each conversation, read back from the examples: n_turns, turns_sha256, loss_chars, loss_sha256 and
    formatted_chars (code points of the longest example, which holds the whole conversation once)."""
    whole = F.when(F.col("is_last"), F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""))
    light = ex.select(
        "conv_id",
        "own",
        F.when(F.col("is_last"), F.size(read_turns(F.col("formatted")))).alias("n"),
        whole.alias("whole"),
        F.when(F.col("is_last"), F.length("formatted")).alias("chars"),
        F.when(F.col("loss_start").isNotNull(), F.struct("example", loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("t"))).alias("loss"),
    )
    g = light.groupBy("conv_id", "own").agg(
        F.max("n").alias("n"),
        F.max("whole").alias("whole"),
        F.max("chars").alias("chars"),
        F.array_join(F.transform(F.sort_array(F.collect_list("loss")), lambda x: x["t"]), "").alias("loss"),
    )
    return g.select(
        "conv_id",
        F.col("n").cast("long").alias("n_turns"),
        F.sha2("whole", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("chars").cast("long").alias("formatted_chars"),
    )
