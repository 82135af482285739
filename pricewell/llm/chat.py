"""Chat formatting: conversations rebuilt from event logs and rendered with a template.

An event log has the columns ``conv_id``, ``place`` (a message's position in its conversation),
``message`` (its id), ``seq``, ``op``, ``role`` and ``text``. The operations are

- ``start``: the message begins, ``role`` speaks and ``text`` is its beginning;
- ``delta``: ``text`` is appended;
- ``edit``: what the message had so far is replaced by ``text``;
- ``regenerate``: what the message had so far is thrown away, ``text`` begins it anew;
- ``retract``: the message goes, unless a later event begins it again.

Only DataFrame functions are used. Events are shuffled once, by conversation and block of places, so a
long conversation spreads over many tasks until its finished blocks are put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
TURN_START = "<|im_start|>"
TURN_END = "<|im_end|>\n"
#: What begins a control string: the strings of this template and of other common ones.
CONTROL = r"(<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\]))"
RESETS = ["start", "edit", "regenerate", "retract"]
#: Finished turns are joined in blocks of so many before the blocks of a conversation are joined.
BLOCK = 256


def escaped(text: Column) -> Column:
    """The text with a backslash after the first character of each control string; backslashes doubled."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def unescaped(text: Column) -> Column:
    """Undoes ``escaped`` exactly: a backslash goes, the character after it stays."""
    return F.regexp_replace(text, r"\\(?s:(.))", "$1")


def _role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\\n"))


def block_of(place: str) -> Column:
    """The block of a place; a null place has one of its own."""
    return F.floor(F.coalesce(F.col(place).cast("double"), F.lit(-1.0)) / BLOCK).cast("long")


def folded(events: DataFrame) -> DataFrame:
    """The final messages: conv_id, block, place, message, role, text.

    Events of a message are taken by ``seq``; an event delivered twice counts once; events that
    share a ``seq`` are taken by op, role and text. The text runs from the last reset on. Null
    texts and roles are empty, unknown operations and null ones are ignored, and a message without
    a start has an empty role. A retracted message is gone. A null conv_id is a conversation of
    its own.
    """
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    known = events.where(F.col("op").isin(*RESETS, "delta")).withColumn("block", block_of("place"))
    # a block's messages meet in one task, where they are folded and later joined
    sets = known.repartition("conv_id", "block").groupBy("conv_id", "block", "place", "message").agg(
        F.array_sort(F.collect_set(F.struct("seq", "op", role, text))).alias("e")
    )
    last = F.array_max(F.transform("e", lambda x, i: F.when(x["op"].isin(RESETS), i + 1).otherwise(F.lit(0))))
    started = F.transform(F.filter("e", lambda x: x["op"] == "start"), lambda x: x["role"])
    from_last = F.slice("e", F.greatest(F.col("last"), F.lit(1)), F.size("e"))
    return (
        sets.withColumn("last", last)
        .where(F.coalesce(F.try_element_at("e", F.nullif("last", F.lit(0)))["op"] != "retract", F.lit(True)))
        .select(
            "conv_id",
            "block",
            "place",
            "message",
            F.coalesce(F.try_element_at(started, F.lit(-1)), F.lit("")).alias("role"),
            F.array_join(F.transform(from_last, lambda x: x["text"]), "").alias("text"),
        )
    )


def rendered(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans.

    A turn is ``<|im_start|>role``, a line end, the text and ``<|im_end|>`` with a line end.
    Control strings inside texts and roles are escaped, so turn marks stand only at turns.
    ``loss_spans`` has for each turn of the ``learn`` role its number and the code points, from the
    turn's beginning, at which the escaped text starts and ends. Messages are ordered by
    ``place``, then ``message``; null roles and texts are empty.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(TURN_START), _role(role), F.lit("\n"))
    body = escaped(text)
    turn = messages.select(
        "conv_id",
        "block" if "block" in messages.columns else block_of("place").alias("block"),
        F.struct("place", "message").alias("at"),
        F.concat(head, body, F.lit(TURN_END)).alias("turn"),
        F.when(role == learn, F.struct(F.length(head).alias("start"), (F.length(head) + F.length(body)).alias("end"))).alias("span"),
    )
    blocks = turn.groupBy("conv_id", "block").agg(
        F.array_sort(F.collect_list(F.struct("at", "turn", "span"))).alias("turns")
    )
    joined = blocks.select(
        "conv_id",
        "block",
        F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda x: x["turn"]), "").alias("text"),
        F.transform("turns", lambda x: x["span"]).alias("spans"),
    )
    whole = joined.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"), F.array_sort(F.collect_list(F.struct("block", "text", "spans"))).alias("b")
    )
    spans = F.flatten(F.transform("b", lambda x: x["spans"]))
    numbered = F.transform(spans, lambda x, i: F.struct(i.alias("turn"), x["start"].alias("start"), x["end"].alias("end")))
    return whole.select(
        "conv_id",
        "n_turns",
        F.array_join(F.transform("b", lambda x: x["text"]), "").alias("formatted"),
        F.filter(numbered, lambda x: x["start"].isNotNull()).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds to rendered conversations what their text and spans say: ``turns`` and ``loss_texts``.

    ``turns`` has the role and text of each turn, ``loss_texts`` the text under each span, all unescaped.
    """
    parts = F.split("formatted", r"(?<=<\|im_end\|>\n)")
    turns = formatted.withColumn("__turn", F.filter(parts, lambda x: x != ""))
    header = r"^<\|im_start\|>((?:[^\\\n]++|\\[\s\S])*+)\n"
    head = F.transform("__turn", lambda x: F.struct(x.alias("turn"), F.regexp_extract(x, header, 1).alias("role")))
    cut = len(TURN_START) + 2

    def parsed(x: Column) -> Column:
        start = F.length(x["role"]) + F.lit(cut)
        text = F.substring(x["turn"], start, F.length(x["turn"]) - start + 1 - F.lit(len(TURN_END)))
        return F.struct(unescaped(x["role"]).alias("role"), unescaped(text).alias("text"))

    return turns.withColumn("turns", F.transform(head, parsed)).withColumn(
        "loss_texts",
        F.transform(
            "loss_spans",
            lambda s: unescaped(F.substring(F.col("__turn")[s["turn"]], s["start"] + 1, s["end"] - s["start"])),
        ),
    ).drop("__turn")


def event_log(conversations: DataFrame, piece: int = 400, draft_chars: int = 40) -> DataFrame:
    """The event log by which a table of turns (conv_id, turn, role, text) would have been streamed.

    An assistant's turn begins with a draft that is thrown away and streamed anew in pieces;
    other turns are begun with a part of the text and then edited. Rows that repeat a turn are
    turns of their own, by role and text: a message's id has the number of its row, which a table read
    from files always gives alike.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    number = F.monotonically_increasing_id().alias("row")
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), number)
    pieces = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("text") - 1) / piece)).cast("int")),
        lambda i: F.substring(F.col("text"), i * piece + 1, F.lit(piece)),
    )
    message = F.struct("role", F.sha2("text", 256).alias("digest"), "row")
    event = lambda seq, op, text: F.struct(seq.alias("seq"), F.lit(op).alias("op"), text.alias("text"))
    draft = F.substring("text", 1, draft_chars)
    streamed = F.concat(
        F.array(event(F.lit(0), "start", F.lit("")), event(F.lit(1), "delta", draft), event(F.lit(2), "regenerate", F.lit(""))),
        F.transform(pieces, lambda x, i: F.struct((i + 3).alias("seq"), F.lit("delta").alias("op"), x.alias("text"))),
    )
    edited = F.array(event(F.lit(0), "start", draft), event(F.lit(1), "edit", F.col("text")))
    return (
        rows.select("conv_id", F.col("turn").alias("place"), message.alias("message"), "role", F.when(F.col("role") == "assistant", streamed).otherwise(edited).alias("e"))
        .select("conv_id", "place", "message", "role", F.explode("e").alias("e"))
        .select("conv_id", "place", "message", "role", "e.seq", "e.op", "e.text")
    )
