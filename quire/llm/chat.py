"""Chat formatting with a grammar round trip, in DataFrame operations only.

Rendered text follows one grammar:

    conversation := turn*
    turn         := "<s>" role "[INST]" text "[/INST]</s>"

The four strings in quotes are control strings. A text may hold them too, so the formatter first renders every turn as it
is, parses the rendering with the deterministic parser below and compares. Where the turns that come back differ, or a
control string would stand inside a turn, the turn's content is escaped: one backslash is put behind the opening character of each control string, and of each control
string that already has backslashes there ("<s>" becomes "<\\s>", "<\\s>" becomes "<\\\\s>"). The parser takes one
backslash away from each such string. Escaped content never holds a control string, and every text has its own escaped
form, so the second rendering parses to its source; ``identical`` says so for each conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, TEXT, END_TEXT, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
_TAIL = r"/?s>|/?INST\]"
#: A control string with any number of backslashes behind its opening character; with one at least.
_ANY = rf"([<\[])(\\*(?:{_TAIL}))"
_STUFFED = rf"([<\[])\\(\\*(?:{_TAIL}))"
_TURN = r"(?s)^<s>(.*?)\[INST\](.*)\[/INST\]$"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, _ANY, r"$1\\$2")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, _STUFFED, "$1$2")


def _render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(TEXT), text, F.lit(END_TEXT + CLOSE))


def parse(formatted: Column) -> Column:
    """The turns of a rendered text: array<struct<role, text, body>>; body is the text as it stands there. A piece outside the grammar gives nulls."""
    pieces = F.split(formatted, CLOSE)
    return F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda p: F.when(
            p.rlike(_TURN),
            F.struct(unescape(F.regexp_extract(p, _TURN, 1)).alias("role"), unescape(F.regexp_extract(p, _TURN, 2)).alias("text"), F.regexp_extract(p, _TURN, 2).alias("body")),
        ),
    )


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, source (array<struct<role, text>>), formatted, loss (array<struct<turn, start, length>>:
    the assistant's texts, in code points from the start of that turn's rendering, turns from 0), escaped (turns that had to
    be), identical (the parsed turns equal the source).

    Turns are ordered by turn; rows with the same turn, and rows that repeat, all stay and are ordered by role, then text; a
    null turn comes first. Null roles and texts count as empty; a null conv_id is a conversation of its own. No conversations
    give no rows. Columns other than conv_id, turn, role and text are ignored, whatever their names.
    """
    empty = lambda c: F.coalesce(conversations[c].cast("string"), F.lit(""))
    rows = conversations.select(conversations["conv_id"].cast("long").alias("conv_id"), F.struct(conversations["turn"].cast("long").alias("turn"), empty("role").alias("role"), empty("text").alias("text")).alias("t"))
    # first rendering: a turn conflicts if it doesn't parse to itself or shows a control string
    alone = parse(_render(F.col("t.role"), F.col("t.text")))
    same = (F.size(alone) == 1) & (F.get(alone, 0)["role"] == F.col("t.role")) & (F.get(alone, 0)["text"] == F.col("t.text"))
    rows = rows.withColumn("conflict", ~F.coalesce(same, F.lit(False)) | F.col("t.role").rlike(_ANY) | F.col("t.text").rlike(_ANY))
    part = lambda c: F.when(F.col("conflict"), escape(F.col(c))).otherwise(F.col(c))
    rows = rows.select("conv_id", F.struct("t.turn", "t.role", "t.text", part("t.role").alias("role_out"), part("t.text").alias("text_out"), "conflict").alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    start = lambda t: F.length(t["role_out"]) + len(OPEN + TEXT)
    out = whole.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
        F.array_join(F.transform("turns", lambda t: _render(t["role_out"], t["text_out"])), "").alias("formatted"),
        F.filter(
            F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", F.struct(i.alias("turn"), start(t).alias("start"), F.length(t["text_out"]).alias("length")))),
            lambda s: s.isNotNull(),
        ).alias("loss"),
        F.size(F.filter("turns", lambda t: t["conflict"])).alias("escaped"),
    )
    back = F.transform(parse(F.col("formatted")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return out.withColumn("identical", F.coalesce(back == F.col("source"), F.lit(False)))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the rendered text and its loss mask hold, read from these two alone."""
    pieces = F.split("formatted", CLOSE)
    df = formatted.select("conv_id", "formatted", "loss", parse(F.col("formatted")).alias("t"), pieces.alias("p"))
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.get("p", s["turn"]), s["start"] + 1, s["length"]))), "")
    return df.select("conv_id", F.col("t"), F.length("formatted").cast("long").alias("formatted_chars"), loss.alias("l")).select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("l").cast("long").alias("loss_chars"),
        F.sha2("l", 256).alias("loss_sha256"),
        "formatted_chars",
    )
