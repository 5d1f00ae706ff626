"""Chat formatting: conversations to training text by a declarative template, and back.

A ``Template`` says how a turn of each role is marked, which text is learned, and which role may follow in which state.
The turn order is judged by a finite-state machine: a turn is a function from states to states, four bits for each
state in one number, and the functions are composed by a running scan, so a long conversation costs no more per turn
than a short one.  ``formatted`` gives each conversation as segments (text, loss), three for each turn: mark, text,
mark.  The formatted text is the segments joined; the loss mask covers the texts of the learned roles and no mark.

Texts cannot forge marks: a backslash is doubled, and one is put behind the first character of every control string,
which ``plain`` takes out again.  ``Template`` refuses marks that could form a control string with what is beside them.
``turns_of`` reads roles and texts back from the formatted text alone.

Everything is columns of one aggregation by conversation.  A conversation is one training text, so it has to fit into
one value of Spark (2 GB); nothing else about a group is bounded or gathered.

Defined cases: turns go by number, those without one first, equal ones by role and text; a null text is empty; a role
that the template does not know, or a null one, is written with a mark of its own and refused by the machine; rows
without conversation id are one conversation; repeated rows are turns of their own; an invalid order is reported
(``valid``, ``first_bad``: the place of the turn from 0) and formatted all the same; ``complete`` says that a valid
conversation ends where it may; extra columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.arrays import running
from cloakframe.functions.text import let


@dataclass(frozen=True)
class Turn:
    """The marks around a text, and whether the text is learned."""

    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """``order``: state -> {role: next state}, beginning in the first state; ``final``: where a conversation may end."""

    turns: dict[str, Turn]
    order: dict[str, dict[str, str]]
    final: tuple[str, ...]
    #: Marks of a turn whose role has none: before the role, between role and text, after the text; and for no role.
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    nameless: str = "[NOROLE]"
    control: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        marks = [m for t in self.turns.values() for m in (t.open, t.close)] + [*self.other, self.nameless]
        found = self.control or tuple(dict.fromkeys(m.strip() for m in marks if m.strip()))
        object.__setattr__(self, "control", found)
        if len(self.order) > 14:
            raise ValueError("at most 14 states")
        if any(len(c) < 2 or "\\" in c for c in found):
            raise ValueError("a control string has two characters at least and no backslash")
        openers = [self._starts(t.open) for t in self.turns.values()]
        if len({*openers, self.other[0], self.nameless}) != len(openers) + 2:
            raise ValueError("every role needs a mark of its own at the front")
        for m in marks:
            for c in found:
                for i in range(1, len(c)):
                    if m and (m.startswith(c[i:]) or c[i:].startswith(m) or m.endswith(c[:i])):
                        raise ValueError(f"{m!r} beside a text could form {c!r}")
            if any(o in m[1:] for o in (*openers, self.other[0], self.nameless)):
                raise ValueError(f"{m!r} holds the front of a turn")

    def _starts(self, mark: str) -> str:
        first = next((c for c in sorted(self.control, key=len, reverse=True) if mark.startswith(c)), None)
        if first is None:
            raise ValueError(f"{mark!r} has to begin with a control string")
        return first

    def openers(self) -> list[str]:
        return [*(self._starts(t.open) for t in self.turns.values()), self.other[0], self.nameless]


#: Instruction marks; a user's turn ends the system's, an assistant's answer is learned.
INSTRUCT = Template(
    turns={"system": Turn("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": Turn("[INST] ", " [/INST]"),
           "assistant": Turn("<s> ", " </s>\n", loss=True)},
    order={"start": {"system": "system", "user": "user"}, "system": {"user": "user"},
           "user": {"assistant": "assistant"}, "assistant": {"user": "user"}},
    final=("assistant",),
)


def _forged(template: Template) -> str:
    """Where a control string begins, behind its first character."""
    tails: dict[str, list[str]] = {}
    for c in template.control:
        tails.setdefault(c[0], []).append(re.escape(c[1:]))
    return "|".join(f"(?<={re.escape(a)})(?={'|'.join(b)})" for a, b in tails.items())


def escaped(text: Column, template: Template) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, F.lit(_forged(template)), F.lit(r"\\"))


def plain(text: Column) -> Column:
    """What ``escaped`` was given."""
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def _function(role: Column, template: Template) -> Column:
    """What a turn does to the states, four bits each; the number behind the last state is a broken order."""
    states = list(template.order)
    broken = len(states)

    def packed(of: str | None) -> Column:
        to = [states.index(template.order[s][of]) if of in template.order[s] else broken for s in states] + [broken]
        return F.lit(sum(t << 4 * i for i, t in enumerate(to))).cast("bigint")

    out = packed(None)
    for r in {r: None for follows in template.order.values() for r in follows}:
        out = F.when(role == r, packed(r)).otherwise(out)
    return out


def states_after(roles: Column, template: Template) -> Column:
    """The number of the state after each turn of an array of roles; the count of states where the order is broken."""

    def composed(f: Column, g: Column) -> Column:
        out = F.lit(0).cast("bigint")
        for i in range(len(template.order) + 1):
            via = F.shiftright(f, 4 * i).bitwiseAND(F.lit(15).cast("bigint")).cast("int") * 4
            to = F.call_function("shiftright", g, via).bitwiseAND(F.lit(15).cast("bigint"))
            out = out.bitwiseOR(F.shiftleft(to, 4 * i))
        return out

    functions = F.transform(roles, lambda r: _function(r, template))
    return F.transform(running(functions, composed), lambda f: f.bitwiseAND(F.lit(15).cast("bigint")).cast("int"))


def _choose(role: Column, template: Template, of: Callable[[Turn], object], other: Column, nameless: Column) -> Column:
    out = F.when(role.isNull(), nameless)
    for name, turn in template.turns.items():
        out = out.when(role == name, F.lit(of(turn)))
    return out.otherwise(other)


def formatted(conversations: DataFrame, template: Template = INSTRUCT, id_col: str = "conv_id", turn_col: str = "turn",
              role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, segments, valid, first_bad, complete): segments are structs of ``text`` and ``loss``."""
    role = F.col(role_col)
    head, between, end = template.other
    rows = conversations.select(
        F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), role.alias("role"),
        escaped(F.coalesce(F.col(text_col), F.lit("")), template).alias("body"),
        _choose(role, template, lambda t: t.open, F.concat(F.lit(head), escaped(role, template), F.lit(between)),
                F.lit(template.nameless)).alias("open"),
        _choose(role, template, lambda t: t.close, F.lit(end), F.lit(end)).alias("close"),
        _choose(role, template, lambda t: t.loss, F.lit(False), F.lit(False)).alias("loss"))
    turns = rows.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "body", "open", "close", "loss"))).alias("turns"))

    def segments(t: Column) -> Column:
        def segment(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))

        return F.array(segment(t["open"], F.lit(False)), segment(t["body"], t["loss"]), segment(t["close"], F.lit(False)))

    broken = len(template.order)
    ends = [list(template.order).index(s) for s in template.final]
    judged = let(states_after(F.transform("turns", lambda t: t["role"]), template), lambda s: F.struct(
        F.array_position(s, F.lit(broken)).alias("bad"), F.element_at(s, -1).alias("last")))
    found = turns.select("id", F.flatten(F.transform("turns", segments)).alias("segments"), judged.alias("j"))
    return found.select(
        "id", "segments", (F.col("j.bad") == 0).alias("valid"),
        F.when(F.col("j.bad") > 0, F.col("j.bad") - 1).alias("first_bad"), F.col("j.last").isin(ends).alias("complete"))


def text_of(segments: Column) -> Column:
    """The formatted text."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def learned(segments: Column) -> Column:
    """All text under the loss mask, as it was before it was escaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: plain(s["text"])), "")


def turns_of(text: Column, template: Template = INSTRUCT) -> Column:
    """The turns of a formatted text, structs of ``role`` and ``text``."""
    head, between, end = template.other
    fronts = "|".join(re.escape(o) for o in sorted(template.openers(), key=len, reverse=True))

    def inside(part: Column, before: Column | int, after: str) -> Column:
        before = F.lit(before) if isinstance(before, int) else before
        return plain(F.substring(part, before + 1, F.length(part) - before - len(after)))

    def turn(role: Column, text: Column) -> Column:
        return F.struct(role.cast("string").alias("role"), text.alias("text"))

    def read(part: Column) -> Column:
        out = F.when(F.startswith(part, F.lit(template.nameless)),
                     turn(F.lit(None), inside(part, len(template.nameless), end)))
        for name, t in template.turns.items():
            out = out.when(F.startswith(part, F.lit(t.open)), turn(F.lit(name), inside(part, len(t.open), t.close)))
        name = F.substring(F.substring_index(part, between, 1), F.lit(len(head) + 1), F.length(part))
        return out.otherwise(turn(plain(name), inside(part, F.length(name) + len(head) + len(between), end)))

    return F.transform(F.filter(F.split(text, f"(?={fronts})", -1), lambda p: p != ""), read)
