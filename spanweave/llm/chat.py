"""Chat formatting by prefix-target expansion, in DataFrame operations only.

Every assistant turn becomes an example of its own: all earlier turns of its conversation are its context, and only
that reply is trainable. A row holds the whole example in template form and the place of its loss mask. Turns after
the last reply, which no example has, make a last row without a mask.

Template: ``<|im_start|>role`` newline, text, ``<|im_end|>`` newline. Control strings inside texts and roles are
escaped with a backslash (``<|`` as ``<`` backslash ``|``, a backslash doubled), so no text can end its turn, and
:func:`read_back` recovers every turn exactly.

Scale: one shuffle by conversation; examples are exploded after it and read back without another. A conversation is
the unit of output (its digest needs all its text), so the longest one bounds a task's memory; its examples repeat
their contexts, by the method's nature, one row at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
ASSISTANT = "assistant"


def escaped(text: Column) -> Column:
    """``text`` without control strings."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escaped_role(role: Column) -> Column:
    """A role may hold anything; its newlines are escaped too, since one ends it."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\\n"))


def examples(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, upto, example, mask_start, mask_end``, one row for each reply, and one for turns after the last.

    ``example`` is the template text of the first ``upto`` turns of the conversation: the context, then the reply.
    The mask is in code points of it, end exclusive, and covers the reply's text; it is null in a row without
    reply. Turns are ordered by number, then role, then text (nulls first); null roles and texts count as empty;
    rows with a null conversation form one conversation; repeated rows stay; extra columns are not read; an empty
    table has no examples.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    head = lambda t: F.concat(F.lit(START), escaped_role(t["role"]), F.lit("\n"))
    piece = F.transform("turns", lambda t: F.struct((t["role"] == ASSISTANT).alias("reply"), F.length(head(t)).alias("head"), F.concat(head(t), escaped(t["text"]), F.lit(END)).alias("piece")))
    whole = whole.select("conv_id", piece.alias("pieces"))
    ends = F.filter(F.sequence(F.lit(1), F.size("pieces")), lambda k: F.get("pieces", k - 1)["reply"] | (k == F.size("pieces")))
    placed = whole.select("conv_id", "pieces", F.explode(ends).alias("upto"))
    last = F.get("pieces", F.col("upto") - 1)
    context = F.array_join(F.transform(F.slice("pieces", F.lit(1), F.col("upto") - 1), lambda p: p["piece"]), "")
    rows = placed.select("conv_id", "upto", context.alias("context"), last.alias("last"))
    start = F.when(F.col("last.reply"), F.length("context") + F.col("last.head"))
    return rows.select(
        "conv_id", "upto", F.concat("context", "last.piece").alias("example"),
        start.alias("mask_start"), (start + F.length("last.piece") - F.col("last.head") - len(END)).alias("mask_end"),
    )


def parsed(segment: Column) -> Column:
    """The turns of a piece of template text: an array of ``role, text``."""
    pieces = F.filter(F.split(segment, r"<\|im_end\|>\n"), lambda p: p != "")

    def turn(p: Column) -> Column:
        role = F.regexp_extract(p, r"(?s)\A<\|im_start\|>((?:[^\\\n]|\\.)*+)\n", 1)
        body = F.substring(p, F.length(role) + len(START) + 2, F.length(p))
        return F.struct(unescaped(role).alias("role"), unescaped(body).alias("text"))

    return F.transform(pieces, turn)


def read_back(found: DataFrame) -> DataFrame:
    """What the examples hold: per conversation its turns' and loss masks' counts and digests.

    Turns are parsed from the longest example, losses are cut from every example by its mask; ``formatted_chars`` is
    the length of the longest, ``expanded_chars`` that of all with a mask.
    """
    loss = unescaped(F.substring(F.col("example"), (F.col("mask_start") + 1).cast("int"), (F.col("mask_end") - F.col("mask_start")).cast("int")))
    size = F.length("example").cast("long")
    rows = found.select("conv_id", "upto", "example", size.alias("size"), F.col("mask_start").isNotNull().alias("reply"), F.when(F.col("mask_start").isNotNull(), loss).alias("loss"))
    whole = rows.groupBy("conv_id").agg(
        F.max_by("example", "upto").alias("example"),
        F.array_sort(F.collect_list(F.when(F.col("reply"), F.struct("upto", "loss")))).alias("losses"),
        F.count_if("reply").alias("n_examples"), F.coalesce(F.sum(F.when(F.col("reply"), F.col("size"))), F.lit(0)).alias("expanded_chars"),
    )
    whole = whole.withColumn("turns", parsed(F.col("example"))).withColumn("lost", F.array_join(F.transform("losses", lambda p: p["loss"]), ""))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"),
        F.sha2(F.encode("lost", "UTF-8"), 256).alias("loss_sha256"),
        F.length("example").cast("long").alias("formatted_chars"), "n_examples", "expanded_chars",
    )
