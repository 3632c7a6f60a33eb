"""Chat formatting: turns to training text with a loss flag per segment, and back.

A template declares the markers, the order of turns as a finite-state machine over roles and
the roles that are learned. Everything is an expression over one conversation's sorted turns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class ChatTemplate:
    """Markers, transitions ``(state, role) -> state``, accepted end states and learned roles.

    ``open`` and ``end`` need at least two characters without a backslash; inside texts and
    roles they get a backslash after their first character, after backslashes were doubled.
    """

    open: str = "### "
    name_end: str = ": "
    end: str = "</turn>"
    between: str = "\n"
    start: str = "start"
    transitions: dict = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    accept: tuple = ("assistant",)
    learned: tuple = ("assistant",)

    def __post_init__(self):
        for mark in (self.open, self.name_end, self.end):
            if len(mark) < 2 or ESCAPE in mark:
                raise ValueError(f"unusable marker: {mark!r}")


def _broken(mark: str) -> str:
    return mark[0] + ESCAPE + mark[1:]


def escape(text: Column, marks: list[str]) -> Column:
    """``text`` without any of ``marks``; ``unescape`` gives it back."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for mark in marks:
        out = F.replace(out, F.lit(mark), F.lit(_broken(mark)))
    return out


def unescape(text: Column, marks: list[str]) -> Column:
    """Inverse of ``escape``: a backslash that breaks a marker always stands alone, all others are doubled."""
    out = text
    for mark in reversed(marks):
        out = F.replace(out, F.lit(_broken(mark)), F.lit(mark))
    return F.replace(out, F.lit(ESCAPE * 2), F.lit(ESCAPE))


def format_chats(
    turns: DataFrame, template: ChatTemplate = ChatTemplate(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: its id, ``valid``, ``formatted`` and ``segments (text, loss)``.

    Turns are ordered by number, then role and text (ties, repeated rows: each counts). A null
    text or role is empty; an empty text is an empty segment. Null conversation ids form one
    conversation; other columns are ignored; no turn gives no row. ``valid`` tells whether the
    machine accepts the roles; conversations it rejects are formatted all the same.
    """
    marks = [template.open, template.end]
    names = [*marks, template.name_end]
    empty = F.lit("")
    rows = turns.select(
        F.col(conv).alias("_conv"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role).cast("string"), empty).alias("role"),
            F.coalesce(F.col(text).cast("string"), empty).alias("text"),
        ).alias("_turn"),
    )
    chats = rows.groupBy("_conv").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))

    def pieces(t: Column) -> Column:
        head = F.concat(F.lit(template.open), escape(t["role"], names), F.lit(template.name_end))
        learn = t["role"].isin(*template.learned)
        parts = [(head, F.lit(False)), (escape(t["text"], marks), learn), (F.lit(template.end + template.between), F.lit(False))]
        return F.array(*[F.struct(x.alias("text"), loss.alias("loss")) for x, loss in parts])

    steps = F.create_map(*[F.lit(x) for (state, r), to in template.transitions.items() for x in (f"{state}\x00{r}", to)])
    after = F.aggregate(
        "_turns",
        F.lit(template.start),
        lambda state, t: F.coalesce(F.element_at(steps, F.concat(state, F.lit("\x00"), t["role"])), F.lit("\x00")),
    )
    segments = F.flatten(F.transform("_turns", pieces))
    return chats.select(
        F.col("_conv").alias(conv), after.isin(*template.accept).alias("valid"), segments.alias("segments")
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """The turns ``(role, text)`` of a formatted conversation."""
    marks = [template.open, template.end]
    names = [*marks, template.name_end]
    stop = template.end + template.between
    parts = F.filter(F.split(formatted, "\\Q" + stop + "\\E", -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        skip = F.lit(len(template.open))
        at = F.instr(p, template.name_end)
        name = F.substring(p, skip + 1, at - 1 - skip)
        body = F.substring(p, at + len(template.name_end), F.length(p))
        return F.struct(unescape(name, names).alias("role"), unescape(body, marks).alias("text"))

    return F.transform(parts, turn)


def learned_text(segments: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    marks = [template.open, template.end]
    kept = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(kept, lambda s: unescape(s["text"], marks)), "")
