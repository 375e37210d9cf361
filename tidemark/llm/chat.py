"""Chat formatting: a finite-state machine over roles and a declarative template, as DataFrame functions alone.

Every turn becomes three segments: the header of its role, its text, the mark that closes it. A segment
carries a loss flag. Inside texts a backslash goes in front of each control string of the template, so no
text can be taken for a mark, and taking off one backslash in front of each gives the text back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """headers: role to what opens its turn. other: opens a turn of any other role, whose name follows in hexadecimal.
    end: closes a turn, on a line of its own. loss: roles whose text is learned. moves: (state, role) to the next state;
    start: the first state; final: states in which a conversation may end."""

    headers: dict[str, str] = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other: str = "### Other "
    end: str = "</turn>"
    loss: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "told",
            ("start", "user"): "asked",
            ("told", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    final: frozenset[str] = frozenset({"answered"})

    def __post_init__(self) -> None:
        marks = self.controls
        for a in marks:
            if not a or "\\" in a or "\n" in a or a != a.strip():
                raise ValueError(f"a control string is one line that has no backslash: {a!r}")
            for b in marks:
                if (a is not b and a in b) or any(b.startswith(a[-k:]) for k in range(1, len(a))):
                    raise ValueError(f"control strings may not overlap: {a!r}, {b!r}")
        if any("\n" in state or "\n" in role for state, role in self.moves):
            raise ValueError("names of states and of roles with a move are one line each")

    @property
    def controls(self) -> list[str]:
        return [*(h.strip() for h in self.headers.values()), self.other.strip(), self.end]

    @property
    def close(self) -> str:
        return f"\n{self.end}\n"

    @property
    def pattern(self) -> str:
        return "(" + "|".join(map(re.escape, self.controls)) + ")"

    def escaped(self, text: Column) -> Column:
        return F.regexp_replace(text, self.pattern, r"\\$1")

    def unescaped(self, text: Column) -> Column:
        return F.regexp_replace(text, r"\\" + self.pattern, "$1")

    def header(self, role: Column) -> Column:
        found = F.concat(F.lit(self.other), F.hex(role.cast("binary")), F.lit(": "))
        for name, header in self.headers.items():
            found = F.when(role == name, F.lit(header)).otherwise(found)
        return found

    def turn(self, part: Column) -> Column:
        """Role and text of what stands before a closing mark."""
        at = F.instr(part, ": ")
        start = F.length(F.lit(self.other))
        found = F.struct(F.unhex(part.substr(start + 1, at - start - 1)).cast("string").alias("role"), self.unescaped(part.substr(at + 2, F.length(part))).alias("text"))
        for name, header in self.headers.items():
            own = F.struct(F.lit(name).alias("role"), self.unescaped(part.substr(F.lit(len(header) + 1), F.length(part))).alias("text"))
            found = F.when(part.startswith(header), own).otherwise(found)
        return found

    def verdict(self, roles: Column) -> Column:
        """valid, and the place of the first turn that has no move (null if all have one), of an array of roles."""
        table = F.create_map(*[F.lit(x) for (state, role), then in self.moves.items() for x in (f"{state}\n{role}", then)])
        # a state of null is final; bad is the place at which it came up
        step = lambda acc, role: F.struct(
            F.try_element_at(table, F.concat(acc["state"], F.lit("\n"), role)).alias("state"),
            (acc["at"] + 1).alias("at"),
            F.coalesce(acc["bad"], F.when(F.try_element_at(table, F.concat(acc["state"], F.lit("\n"), role)).isNull(), acc["at"])).alias("bad"),
        )
        zero = F.struct(F.lit(self.start).alias("state"), F.lit(0).cast("long").alias("at"), F.lit(None).cast("long").alias("bad"))
        return F.aggregate(roles, zero, step, lambda acc: F.struct(F.coalesce(acc["state"].isin(*self.final), F.lit(False)).alias("valid"), acc["bad"].alias("first_bad")))


def formatted(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, n_turns, valid, first_bad, segments (array of text, loss) and formatted of every conversation.

    turns: conv_id, turn, role, text; other columns are left aside. Turns stand in the order of turn, ties in
    that of role and escaped text; repeated rows stay. A null text or role counts as empty, rows without
    conv_id are one conversation, an empty table gives no rows. A conversation whose order the machine
    rejects is formatted all the same; valid and first_bad (its first wrong place, from 0) tell of it.
    Texts are escaped before the one shuffle; a conversation has to fit into a row, as its string does.
    """
    template = template or Template()
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn"), role.alias("role"), template.escaped(text).alias("body"), template.header(role).alias("head")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def segments(t: Column) -> Column:
        learned = F.lit(False)
        for name in sorted(template.loss):
            learned = learned | (t["role"] == name)
        made = ((t["head"], F.lit(False)), (t["body"], learned), (F.lit(template.close), F.lit(False)))
        return F.array(*[F.struct(x.alias("text"), flag.alias("loss")) for x, flag in made])

    found = whole.select("conv_id", F.size("ts").cast("long").alias("n_turns"), template.verdict(F.col("ts.role")).alias("v"), F.flatten(F.transform("ts", segments)).alias("segments"))
    return found.select("conv_id", "n_turns", "v.*", "segments", F.array_join("segments.text", "").alias("formatted"))


def read_back(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """rows with turns (array of role, text), out of the string formatted, and loss_text, out of the segments under the mask."""
    template = template or Template()
    parts = F.split("formatted", re.escape(template.close), -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)  # nothing stands after the last mark
    learned = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.unescaped(s["text"]))
    return rows.withColumns({"turns": F.transform(parts, template.turn), "loss_text": F.array_join(learned, "")})
