"""Chat formatting: a finite-state machine over roles, and a declarative template that emits text segments with loss flags.

Native: DataFrame functions only. One conversation is one output row, so its turns meet in one task; nothing else does.

Defined cases: a null text or role is empty; turns sort by (turn, role, text), null turns first; repeated rows are
repeated turns; a null conv_id is a conversation of its own; an empty table gives no rows. A conversation whose roles
the machine refuses is still formatted, with `valid` false.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Marks around turns, which roles are trained on, and the machine that turn order must follow.

    `escapes` are (character, code) pairs: each is written in order and undone in reverse. The first is the escape
    character itself; the marks must be made of text in which an escaped role or text can't end early.
    """

    open: str = "<turn "
    named: str = ">\n"
    close: str = "\n</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
    start: str = "start"
    transitions: dict = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user", "tool": "tool"},
            "tool": {"tool": "tool", "assistant": "assistant"},
        }
    )
    accepting: tuple[str, ...] = ("assistant",)


DEFAULT = ChatTemplate()


def escaped(text: Column, template: ChatTemplate = DEFAULT) -> Column:
    for char, code in template.escapes:
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescaped(text: Column, template: ChatTemplate = DEFAULT) -> Column:
    for char, code in reversed(template.escapes):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def final_state(roles: Column, template: ChatTemplate = DEFAULT) -> Column:
    """The state after the roles, or `error` from the first role that the machine refuses."""
    edges = [(f"{at}>{role}", to) for at, moves in template.transitions.items() for role, to in moves.items()]
    step = F.create_map(*[F.lit(x) for edge in edges for x in edge])
    return F.aggregate(roles, F.lit(template.start), lambda at, role: F.coalesce(step[F.concat(at, F.lit(">"), role)], F.lit("error")))


def format_conversations(turns: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, formatted, segments array<struct<text, loss>>, valid.

    The segments joined are `formatted`; only the texts of the loss roles carry loss.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn"), role.alias("role"), text.alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(F.concat(F.lit(template.open), escaped(t["role"], template), F.lit(template.named)).alias("text"), F.lit(False).alias("loss")),
                F.struct(escaped(t["text"], template).alias("text"), t["role"].isin(*template.loss_roles).alias("loss")),
                F.struct(F.lit(template.close).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    return whole.select(
        "conv_id",
        F.array_join(F.transform(segments, lambda s: s["text"]), "").alias("formatted"),
        segments.alias("segments"),
        final_state(F.transform("turns", lambda t: t["role"]), template).isin(*template.accepting).alias("valid"),
    )


def read_back(formatted: Column, template: ChatTemplate = DEFAULT) -> Column:
    """array<struct<role, text>> of a formatted conversation, from its text alone."""
    parts = F.split(formatted, r"\Q" + template.close + r"\E", -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)  # what follows the last close is empty

    def turn(part: Column) -> Column:
        at = F.instr(part, template.named)
        return F.struct(
            unescaped(F.substr(part, F.lit(len(template.open) + 1), at - len(template.open) - 1), template).alias("role"),
            unescaped(F.substr(part, at + len(template.named)), template).alias("text"),
        )

    return F.transform(parts, turn)


def loss_text(segments: Column, template: ChatTemplate = DEFAULT) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")
