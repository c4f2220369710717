"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

Events of a conversation (messages, streamed deltas, edits, regenerations, retractions) are grouped
by message, sorted by sequence and folded into the final message; messages are then rendered by a
template that marks turns. Control strings inside roles and texts are escaped reversibly, so the
turns and the text under the loss mask can be read back from what was written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template's control strings. A backslash after the first character takes their meaning away.
TURN, ROLE, TEXT, END = "<s>", "[INST]", "[/INST]", "</s>"
_CONTROL = r"<(?=/?s>)|\[(?=/?INST\])"
_TURNS = r"(?s)<s>\[INST\](.*?)\[/INST\](.*?)</s>"

#: Kinds of events that set a message's text, whatever came before.
SETS = ("message", "edit", "regenerate")


def escape(text: Column) -> Column:
    """Doubles each backslash, then puts one after the first character of each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, "$0\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages of an event log: conv_id, position, role, text.

    ``events``: conv_id, seq, message, kind, role, text; other columns are left aside. Kinds:
    ``message``, ``edit`` and ``regenerate`` set the text, ``delta`` adds to it, ``retract`` takes the
    message away until it is set again; another or null kind counts as ``message``. Ties in seq are
    taken in order of kind, role and text. A message stands where its first event was (ties by
    message), and has the last role that is not null. Null texts are empty; null ids are a
    conversation (or message) of their own. No events give no messages.
    """
    kind = F.when(F.col("kind").isin("delta", "edit", "regenerate", "retract"), F.col("kind")).otherwise("message")
    event = F.struct("seq", kind.alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    by_message = events.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(event)).alias("log"))
    last = lambda kinds: F.array_max(F.transform("log", lambda e, i: F.when(e["kind"].isin(*kinds), i).otherwise(-1)))
    set_at, gone_at = last(SETS), last(("retract",))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    live = F.slice("log", F.greatest(set_at, F.lit(0)) + 1, F.size("log"))
    return by_message.filter(set_at >= gone_at).select(
        "conv_id",
        F.struct(F.col("log")[0]["seq"].alias("seq"), F.col("message").alias("message")).alias("position"),
        F.try_element_at(roles, F.lit(-1)).alias("role"),
        F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a conversation: conv_id, ``formatted`` and ``segments`` (text, loss), which concatenate to it.

    Messages come in order of position; ties by role, then text. Loss covers the escaped text of the
    roles in ``learned``, and no mark. A null role is written as an empty one.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    loss = role.isin(*learned)
    whole = F.struct(
        "position",
        F.concat(F.lit(TURN + ROLE), escape(role), F.lit(TEXT)).alias("before"),
        escape(text).alias("text"),
        loss.alias("loss"),
    )
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(whole)).alias("turns"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(t["before"].alias("text"), F.lit(False).alias("loss")),
                F.struct(t["text"].alias("text"), t["loss"].alias("loss")),
                F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    return turns.select("conv_id", segments.alias("segments")).select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    part = lambda k: F.transform(F.regexp_extract_all(formatted, F.lit(_TURNS), F.lit(k)), unescape)
    return F.arrays_zip(part(1).alias("role"), part(2).alias("text"))


def read_loss(segments: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def as_events(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) as events that each set a message; repeated rows are messages too."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text").withColumn("message", F.col("seq"))
