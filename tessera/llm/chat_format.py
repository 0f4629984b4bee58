"""Chat formatting with DataFrame functions only: a declarative template, a finite-state machine over roles,
text segments with loss flags, and a reader that recovers the turns.

A template names its control strings; each of them starts with "<|". Inside texts and roles every "<", any
number of backslashes, "|" gets one more backslash before the bar, so no text holds a control string, and
the reader takes one away again. A role's backslashes and line ends are written as "\\\\" and "\\n".

Null texts and roles count as empty. Rows are ordered by turn (nulls first), ties by role, then text;
repeated rows are turns of their own. A null conversation id is a conversation. Extra columns are ignored.
An empty table gives an empty result. A conversation that breaks the turn order is still formatted; `state`
is then `invalid` and `first_bad` the number of its first turn out of order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What goes around a turn, which roles are trained on, and which role may follow in which state."""

    open: str = "<|im_start|>"
    close: str = "<|im_end|>"
    after_role: str = "\n"
    after_turn: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accept: tuple[str, ...] = ("answered",)
    #: (state, role) -> next state
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "told",
            ("start", "user"): "asked",
            ("told", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
            ("answered", "tool"): "asked",
            ("asked", "tool"): "asked",
        }
    )


CHATML = Template()


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\\\|", r"<$1|")


def _role_out(c: Column) -> Column:
    return F.replace(F.replace(escaped(c), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _role_in(c: Column) -> Column:
    # a doubled backslash is one, and between two of these a backslash and an n are a line end
    parts = F.transform(F.split(c, r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return unescaped(F.array_join(parts, "\\"))


def _next(template: Template, state: Column, role: Column) -> Column:
    move = F.lit("invalid")
    for (was, said), to in template.moves.items():
        move = F.when((state == was) & (role == said), F.lit(to)).otherwise(move)
    return move


def format_chats(rows: DataFrame, template: Template = CHATML, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv, segments, formatted, state, first_bad.

    A segment has the text as it stands in the output and whether the loss counts on it; the segments joined
    are `formatted`.
    """
    t = rows.select(F.col(conv).alias("conv"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    t = t.groupBy("conv").agg(F.array_sort(F.collect_list("t"), lambda a, b: _order(a, b)).alias("turns"))
    walk = F.aggregate(
        F.col("turns"),
        F.struct(F.lit(template.start).alias("state"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("bad")),
        lambda s, x: _step(template, s, x),
    )
    segments = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                F.struct(F.concat(F.lit(template.open), _role_out(x["role"]), F.lit(template.after_role)).alias("text"), F.lit(False).alias("loss")),
                F.struct(escaped(x["text"]).alias("text"), x["role"].isin(*template.loss_roles).alias("loss")),
                F.struct(F.lit(template.close + template.after_turn).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    out = t.select("conv", walk.alias("walk"), segments.alias("segments"))
    state = F.col("walk.state")
    return out.select(
        F.col("conv").alias(conv),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.when(state == "invalid", state).when(state.isin(*template.accept), F.lit("complete")).otherwise(F.lit("open")).alias("state"),
        F.col("walk.bad").alias("first_bad"),
    )


def _order(a: Column, b: Column) -> Column:
    def by(x: Column, y: Column, rest: Column) -> Column:
        return F.when(x.eqNullSafe(y), rest).when(x.isNull() | (x < y), F.lit(-1)).otherwise(F.lit(1))

    return by(a["turn"], b["turn"], by(a["role"], b["role"], by(a["text"], b["text"], F.lit(0))))


def _step(template: Template, s: Column, x: Column) -> Column:
    to = _next(template, s["state"], x["role"])
    return F.struct(to.alias("state"), (s["n"] + 1).alias("n"), F.coalesce(s["bad"], F.when(to == "invalid", s["n"])).alias("bad"))


def read_chats(formatted: DataFrame, template: Template = CHATML, column: str = "formatted") -> DataFrame:
    """Adds `turns`, an array of (role, text) read back from the formatted text alone."""
    end = template.close + template.after_turn
    parts = F.split(F.col(column), re.escape(end))
    parts = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))  # nothing follows the last end

    def turn(p: Column) -> Column:
        body = F.substring(p, F.lit(len(template.open) + 1), F.length(p))
        at = F.instr(body, template.after_role)
        rest = F.substring(body, at + len(template.after_role), F.length(body))
        return F.struct(_role_in(F.substring(body, F.lit(1), at - 1)).alias("role"), unescaped(rest).alias("text"))

    return formatted.withColumn("turns", F.transform(parts, turn))


def chat_digest(formatted: DataFrame, template: Template = CHATML, conv: str = "conv_id") -> DataFrame:
    """Counts and digests of what read_chats and the segments give back."""
    back = read_chats(formatted, template)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    return back.select(conv, "turns", "state", "first_bad", said.alias("said"), learned.alias("learned"), F.length("formatted").cast("long").alias("formatted_chars")).select(
        conv,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2("said", 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
        "state",
        "first_bad",
    )
