"""Chat formatting: a finite-state machine over roles and a declarative template, in built-in functions only.

A conversation is formatted as one string of turns, ``open role sep text close``. Inside roles and texts
every character that could begin a control string is written as an escape, so a control string in the
output is always one of the template's, and ``read_turns`` gives back the very roles and texts.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Control strings, escapes and the machine over roles.

    ``escapes`` are (character, replacement) in writing order; the first must be the escape character
    itself, and no replacement may hold a later character. ``moves`` are (state, role, next state); the
    machine begins in ``start`` and a missing move makes the conversation invalid.
    """

    open: str = "### "
    sep: str = ": "
    close: str = "</turn>\n"
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))
    learned: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: tuple[tuple[str, str, str], ...] = field(
        default=(
            ("start", "system", "ready"),
            ("start", "user", "asked"),
            ("ready", "user", "asked"),
            ("asked", "assistant", "answered"),
            ("answered", "user", "asked"),
        )
    )


CHAT = Template()


def escaped(text: Column, t: Template) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), t.escapes, text)


def unescaped(text: Column, t: Template) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), reversed(t.escapes), text)


def _valid(turns: Column, t: Template) -> Column:
    """The machine as one fold: the state after each role, ``''`` once no move fits."""

    def step(state: Column, turn: Column) -> Column:
        to = F.lit("")
        for source, role, target in t.moves:
            to = F.when((state == source) & (turn["role"] == role), F.lit(target)).otherwise(to)
        return to

    return F.aggregate(turns, F.lit(t.start), step) != ""


def format_chat(rows: DataFrame, t: Template = CHAT, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id``, ``valid``, ``segments`` (text, loss) and ``formatted``.

    ``segments`` joined are ``formatted``; ``loss`` marks what is trained on, the escaped texts of the
    learned roles. Rows are ordered by turn, NULL turns first, ties by role and text; repeated rows stay.
    A NULL role or text counts as empty, a NULL conversation id is an id of its own. A role that is no
    part of the machine is formatted all the same and makes the conversation invalid. An empty table gives
    no rows; other columns are dropped. One shuffle, by conversation.
    """
    turns = rows.groupBy(F.col(conv).alias("conv_id")).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.coalesce(F.col(turn).cast("long"), F.lit(-(2**63))).alias("turn"),
                    F.coalesce(F.col(role), F.lit("")).alias("role"),
                    F.coalesce(F.col(text), F.lit("")).alias("text"),
                )
            )
        ).alias("turns")
    )

    def segments(x: Column) -> Column:
        piece = lambda value, loss: F.struct(value.alias("text"), loss.alias("loss"))
        return F.array(
            piece(F.concat(F.lit(t.open), escaped(x["role"], t), F.lit(t.sep)), F.lit(False)),
            piece(escaped(x["text"], t), x["role"].isin(*t.learned)),
            piece(F.lit(t.close), F.lit(False)),
        )

    made = turns.select("conv_id", _valid(F.col("turns"), t).alias("valid"), F.flatten(F.transform("turns", segments)).alias("segments"))
    return made.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column, t: Template = CHAT) -> Column:
    """The turns of a formatted conversation: array of (role, text), as they went in."""
    parts = F.split_part  # the text up to, or after, the first separator
    bare = lambda p: F.substr(p, F.lit(len(t.open) + 1))
    role = lambda p: parts(bare(p), F.lit(t.sep), F.lit(1))
    text = lambda p: F.substr(bare(p), F.length(role(p)) + F.lit(len(t.sep) + 1))
    turns = F.slice(F.split(formatted, f"\\Q{t.close}\\E"), F.lit(1), F.size(F.split(formatted, f"\\Q{t.close}\\E")) - 1)
    return F.transform(turns, lambda p: F.struct(unescaped(role(p), t).alias("role"), unescaped(text(p), t).alias("text")))


def learned_text(segments: Column, t: Template = CHAT) -> Column:
    """What the loss mask covers, unescaped, with nothing between the segments."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], t)), "")
