"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of a formatted conversation::

    conversation := turn*
    turn         := "<|im_start|>" role "\\n" text "<|im_end|>\\n"

A conversation is first rendered as it is and reparsed by the deterministic parser. If the recovered
turns differ from the source in any way, its texts and roles are escaped and the result is parsed
again. The escape puts one backslash between ``<`` and ``|`` wherever ``<``, any number of
backslashes and ``|`` stand in a row, and the parser takes one away; it is a bijection whose image
has no ``<|``, so the second round always gives the source back (``round_trip`` says so per row). A
line break in a role becomes ``<|nl|>``, which escaped roles can't contain.

Nulls: a null role or text is the empty string; rows whose turn is null come first; rows with equal
turns are ordered by role, then text; a null conv_id is a conversation of its own. An empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>\n", "<|nl|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _encode_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(BREAK))


def _render(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END))))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation (role, text), or null if it doesn't follow the grammar."""
    pieces = F.split(formatted, r"<\|im_start\|>")
    body = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    at = lambda p: F.instr(p, "\n")
    good = F.forall(body, lambda p: (at(p) > 0) & p.endswith(END) & (F.length(p) >= at(p) + len(END)) & (F.instr(p, END.strip()) == F.length(p) - len(END) + 1))
    turns = F.transform(
        body,
        lambda p: F.struct(
            unescape(F.replace(F.substring(p, F.lit(1), at(p) - 1), F.lit(BREAK), F.lit("\n"))).alias("role"),
            unescape(F.substring(p, at(p) + 1, F.length(p) - at(p) - len(END))).alias("text"),
        ),
    )
    return F.when((F.element_at(pieces, 1) == "") & good, turns)


def format_chats(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conv_id: ``formatted``, ``escaped`` (whether the raw form was ambiguous), ``loss_mask``
    (runs of code points of ``formatted``, on inside the texts of ``loss_role``), ``round_trip`` and ``turns`` (reparsed).
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    source = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text")))
    safe = F.transform("source", lambda t: F.struct(_encode_role(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    chats = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows")).select("conv_id", source.alias("source"))
    chats = chats.withColumn("formatted", _render(F.col("source")))
    chats = chats.withColumn("escaped", ~F.coalesce(parse(F.col("formatted")) == F.col("source"), F.lit(False)))
    chats = chats.withColumn("sent", F.when(F.col("escaped"), safe).otherwise(F.col("source")))
    chats = chats.withColumn("formatted", F.when(F.col("escaped"), _render(F.col("sent"))).otherwise(F.col("formatted")))
    chats = chats.withColumn("turns", parse(F.col("formatted")))
    on = lambda t: t["role"] == loss_role
    run = lambda n, b: F.struct(n.cast("long").alias("chars"), F.lit(b).alias("loss"))
    head = lambda t: F.length(t["role"]) + len(START) + 1
    mask = F.flatten(F.transform("sent", lambda t: F.array(run(head(t), False), F.when(on(t), run(F.length(t["text"]), True)).otherwise(run(F.length(t["text"]), False)), run(F.lit(len(END)), False))))
    return chats.select("conv_id", "formatted", "escaped", mask.alias("loss_mask"), (F.col("turns") == F.col("source")).alias("round_trip"), "turns")


def masked_text(formatted: Column, mask: Column) -> Column:
    """What stands under the loss mask, unescaped run by run.

    The mask's runs are laid over the formatted text turn by turn (three runs each: up to the text, the text,
    its end), so every run is cut from its own turn, and the cost is linear in the conversation.
    """
    pieces = F.split(formatted, r"<\|im_start\|>")
    turns = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def cut(piece: Column, i: Column) -> Column:
        head, run, tail = (F.get(mask, 3 * i + k) for k in range(3))
        at = head["chars"].cast("int") - len(START)
        end = at + run["chars"].cast("int")
        before = F.when(head["loss"], F.substring(piece, F.lit(1), at)).otherwise("")
        inside = F.when(run["loss"], unescape(F.substring(piece, at + 1, run["chars"].cast("int")))).otherwise("")
        after = F.when(tail["loss"], F.substring(piece, end + 1, tail["chars"].cast("int"))).otherwise("")
        return F.concat(before, inside, after)

    return F.concat_ws("", F.transform(turns, cut))


def chat_digest(chats: DataFrame) -> DataFrame:
    """Counts and digests of what is read back from ``formatted``: turns by the parser, loss text by the mask."""
    loss = masked_text(F.col("formatted"), F.col("loss_mask"))
    everything = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return chats.withColumn("loss_text", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(everything.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "escaped",
        "round_trip",
    )
