"""Chat formatting by event-sourced reconstruction.

An event log is partitioned by conversation and ordered by sequence number; streamed deltas,
edits and regenerations are folded into final messages, which a template renders. Everything is
SQL functions. Events are gathered by message, so a long stream of deltas is as large as the
message it makes; only messages, folded already, are ordered by conversation, and what is
gathered last is the output row itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A turn is HEAD, its role, MIDDLE, its text, TAIL. Inside roles and texts the characters of
#: ESCAPES are replaced, so neither a head nor a tail can occur there.
HEAD, MIDDLE, TAIL = "### ", ": ", " </turn>\n"
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def escape(text: Column) -> Column:
    """Replace control characters, the backslash first."""
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    """Undo escape(), the backslash last."""
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def fold_messages(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message_id, role, text) of an event log.

    Columns: conv_id, seq, message_id, kind, role, text. Kinds: ``message`` starts or replaces a
    message with a text, ``delta`` adds to it, ``edit`` replaces its text, ``regenerate`` starts
    it anew from the event's text. An edit or regeneration of a message drops what was said
    before it in later messages of the conversation, as those answered the old version.

    Nulls: a null text is empty, a null role is empty, a null kind is ``message``; a null conv_id
    is a conversation of its own and a null message_id its first message. Events with equal seq
    are taken in order of message_id, kind, role and text, nulls first; repeated rows count as
    often as they occur. Empty tables give no rows; further columns are ignored.
    """
    kind = F.coalesce(F.col("kind"), F.lit("message"))
    rows = events.select("conv_id", "message_id", F.struct("seq", "message_id", kind.alias("kind"), F.coalesce("role",
        F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("e"))
    messages = rows.groupBy("conv_id", "message_id").agg(
        F.sort_array(F.collect_list("e")).alias("parts"),
        F.max(F.when(F.col("e.kind") != "delta", F.col("e"))).alias("start"),
        F.max(F.when(F.col("e.kind").isin("edit", "regenerate"), F.col("e"))).alias("change"),
    )
    before = Window.partitionBy("conv_id").orderBy("message_id").rowsBetween(Window.unboundedPreceding, -1)
    messages = messages.withColumn("cut", F.max("change").over(before))
    alive = lambda e: (F.col("start").isNull() | (e >= F.col("start"))) & (F.col("cut").isNull() | (e > F.col("cut")))
    messages = messages.select("conv_id", "message_id", F.filter("parts", alive).alias("parts")).filter(F.size("parts") > 0)
    return messages.select("conv_id", "message_id", F.col("parts")[0]["role"].alias("role"), F.array_join(F.col("parts.text"), "").alias("text"))


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans.

    ``loss_spans`` are the (start, length) in code points of the rendered texts with role
    ``learn``: the part of ``formatted`` that a loss is taken on. Messages stand in order of
    message_id, ties by role and text.
    """
    turn = F.struct(escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"))
    turns = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("message_id"), F.col("role").alias("plain"),
        F.col("text").alias("body"), turn.alias("turn")))).alias("turns"))
    frame = len(HEAD) + len(MIDDLE) + len(TAIL)
    start = {"at": F.lit(0).cast("long"), "spans": F.array().cast("array<struct<start:bigint,length:bigint>>")}

    def step(state: Column, item: Column) -> Column:
        role, text = F.length(item["turn"]["role"]), F.length(item["turn"]["text"])
        span = F.struct((state["at"] + len(HEAD) + len(MIDDLE) + role).cast("long").alias("start"), text.cast("long").alias("length"))
        return F.struct((state["at"] + frame + role + text).cast("long").alias("at"), F.when(item["plain"] == learn,
            F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    text = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(HEAD), t["turn"]["role"], F.lit(MIDDLE), t["turn"]["text"], F.lit(TAIL))), "")
    spans = F.aggregate("turns", F.struct(start["at"].alias("at"), start["spans"].alias("spans")), step)["spans"]
    return turns.select("conv_id", text.alias("formatted"), spans.alias("loss_spans"))


def format_conversations(events: DataFrame, learn: str = "assistant") -> DataFrame:
    """Fold an event log and render it: conv_id, formatted, loss_spans. See the two parts."""
    return render(fold_messages(events), learn)


def parse(formatted: Column) -> Column:
    """Read a rendered conversation back: array<struct<role, text>>."""
    pieces = F.filter(F.split(formatted, HEAD), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(unescape(F.substring_index(p, MIDDLE, 1)).alias("role"), unescape(_inner(p)).alias("text")))


def _inner(piece: Column) -> Column:
    at = F.instr(piece, MIDDLE) + len(MIDDLE)
    return F.substring(piece, at, F.length(piece) - at + 1 - len(TAIL))


def digest(conversations: DataFrame) -> DataFrame:
    """Digests of rendered conversations, all read from ``formatted`` and ``loss_spans``."""
    turns = F.array_join(F.transform(parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"),
        s["length"].cast("int")))), "")
    return conversations.select(
        "conv_id",
        F.size(parse(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def events_of_turns(conversations: DataFrame) -> DataFrame:
    """A table of turns (conv_id, turn, role, text) as the event log of how they came about.

    Roles but ``assistant`` write a draft, the first half, and edit it; the assistant streams a
    first answer, starts anew and streams the text in two halves. Folding gives the turns back.
    Turns are ordered by turn, nulls last, then role and text; repeated rows stay apart.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    rows = conversations.select("conv_id", F.row_number().over(order).cast("long").alias("message_id"), "role", F.coalesce("text", F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    first, second = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    event = lambda n, kind, text: F.struct((F.col("message_id") * 8 + n).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    written = F.array(event(0, "message", first), event(1, "edit", F.col("text")))
    streamed = F.array(event(0, "message", second), event(1, "delta", first), event(2, "regenerate", first), event(3, "delta", second))
    events = rows.select("conv_id", "message_id", "role", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(written)).alias("e"))
    return events.select("conv_id", "e.seq", "message_id", "e.kind", "role", "e.text")
