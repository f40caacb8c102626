"""Conversations of different layouts as canonical turns, and as one training text.

Everything here is DataFrame expressions. A record's schema fingerprint is the hash
of the sorted nested field paths that it fills. Each layout declares the paths that it
needs and those it may have; the fingerprints of its combinations select it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A declarative mapping from one record layout to turns.

    ``turns`` names an array of structs with the fields ``role`` and ``text``; or
    ``fields`` lists (role, path) in order, paths that are absent giving no turn.
    ``roles`` renames roles.
    """

    name: str
    needs: tuple[str, ...]
    may: tuple[str, ...] = ()
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, str], ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def paths(self) -> list[list[str]]:
        """The sets of filled paths that this layout stands for, each sorted."""
        return [
            sorted({*self.needs, *some}) for n in range(len(self.may) + 1) for some in combinations(self.may, n)
        ]

    def canonical(self) -> Column:
        if self.turns is None:
            parts = [
                F.when(F.col(path).isNotNull(), F.struct(F.lit(role).alias("role"), F.col(path).cast("string").alias("text")))
                for role, path in self.fields
            ]
            return F.array_compact(F.array(*parts))

        def turn(item: Column) -> Column:
            said = F.coalesce(item[self.role].cast("string"), F.lit(""))
            for old, new in self.roles.items():
                said = F.when(item[self.role] == old, F.lit(new)).otherwise(said)
            return F.struct(said.alias("role"), F.coalesce(item[self.text].cast("string"), F.lit("")).alias("text"))

        return F.transform(F.filter(self.turns, lambda item: item.isNotNull()), turn)


LAYOUTS: tuple[Layout, ...] = (
    Layout("messages", ("messages",), ("messages[].role", "messages[].content"), turns="messages"),
    Layout(
        "from_value", ("conversations",), ("conversations[].from", "conversations[].value"), turns="conversations",
        role="from", text="value", roles={"human": "user", "gpt": "assistant", "bot": "assistant"},
    ),
    Layout(
        "instruction", ("instruction",), ("input", "output", "system"),
        fields=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")),
    ),
    Layout(
        "prompt_response", ("prompt",), ("response", "system"),
        fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")),
    ),
    Layout(
        "prompt_completion", ("prompt", "completion"), ("system",),
        fields=(("system", "system"), ("user", "prompt"), ("assistant", "completion")),
    ),
    Layout("question_answer", ("question",), ("answer",), fields=(("user", "question"), ("assistant", "answer"))),
)


def _filled(schema: T.StructType, at: str = "") -> list[tuple[str, Column]]:
    """(path, whether a record fills it) of the schema's fields, down to the items of arrays of structs."""
    found = []
    for f in schema.fields:
        path = f"{at}{f.name}"
        value = F.col(".".join(f"`{part}`" for part in path.split(".")))
        if isinstance(f.dataType, T.StructType):
            found += _filled(f.dataType, f"{path}.")
        else:
            found.append((path, value.isNotNull()))
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            for inner in f.dataType.elementType.fieldNames():
                found.append((f"{path}[].{inner}", _in_any(value, inner)))
    return found


def _in_any(items: Column, name: str) -> Column:
    return F.exists(items, lambda item: item[name].isNotNull())


def fingerprint(schema: T.StructType) -> Column:
    """Hash of the sorted nested field paths that a record fills."""
    paths = sorted(_filled(schema), key=lambda pair: pair[0])
    names = F.array_compact(F.array(*[F.when(F.coalesce(filled, F.lit(False)), F.lit(path)) for path, filled in paths]))
    return F.sha2(F.array_join(names, "\n"), 256)


def canonical_turns(records: DataFrame, id_column: str, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """(id, layout, fingerprint, turns) of records whose other columns may follow any of the layouts.

    Read mixed JSON into one table (its schema is the union of the layouts) and give it
    here. Fields of the record that no layout knows count as paths too, but for the id:
    such a record, and one that fills no path, has a null layout and null turns, so it
    is seen and not guessed at. Null texts and roles inside turns are empty; null turns
    are left out. A layout whose columns the table lacks is not used. Repeated records
    are kept; an empty table gives an empty result.
    """
    body = T.StructType([f for f in records.schema.fields if f.name != id_column])
    there = {path for path, _ in _filled(body)}
    mark = fingerprint(body)
    layout, turns, seen = F.lit(None).cast("string"), F.lit(None).cast(TURNS), set()
    for own in layouts:
        if not {p for p in own.needs} <= there or (own.turns and not {f"{own.turns}[].{own.role}", f"{own.turns}[].{own.text}"} <= there):
            continue
        usable = Layout(
            own.name, own.needs, tuple(p for p in own.may if p in there), own.turns, own.role, own.text,
            tuple((role, path) for role, path in own.fields if path in there), own.roles,
        )
        prints = [F.sha2(F.lit("\n".join(paths)), 256) for paths in usable.paths() if tuple(paths) not in seen]
        seen |= {tuple(paths) for paths in usable.paths()}
        if prints:
            chosen = F.col("fingerprint").isin(*prints)
            layout = F.when(chosen, F.lit(own.name)).otherwise(layout)
            turns = F.when(chosen, usable.canonical().cast(TURNS)).otherwise(turns)
    marked = records.withColumn("fingerprint", mark)
    return marked.select(F.col(id_column).alias("id"), layout.alias("layout"), "fingerprint", turns.alias("turns"))


#: What begins a turn, ends its role and ends the turn.
BEGIN, SAYS, END = "### ", ":\n", "</turn>\n"
#: Text to escape, in this order; read back in the opposite order. No escape makes a control string.
_ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e"))
_ROLE_ESCAPES = (*_ESCAPES, (":", "\\c"))


def _replaced(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column, pairs=_ESCAPES) -> Column:
    return _replaced(text, pairs)


def unescape(text: Column, pairs=_ESCAPES) -> Column:
    return _replaced(text, [(new, old) for old, new in reversed(pairs)])


def format_turns(turns: DataFrame, learn: Sequence[str] = ("assistant",)) -> DataFrame:
    """``turns`` (id, turns) with ``formatted`` and ``loss_spans``.

    Each turn reads ``### role:``, a line break, the text, ``</turn>`` and a line break.
    A backslash, ``###`` and ``</turn>`` inside texts (and ``:`` in roles) are escaped, so that
    only the template's own marks remain. ``loss_spans`` are the code points
    [start, end) of the texts of roles in ``learn``. Without turns (null or none) the
    text is empty. The work on one conversation is linear in its text, and quadratic,
    with eight bytes, in its number of turns.
    """
    parts = F.transform(
        F.coalesce("turns", F.array().cast(TURNS)),
        lambda t: F.struct(
            F.concat(F.lit(BEGIN), escape(t["role"], _ROLE_ESCAPES), F.lit(SAYS)).alias("head"),
            escape(t["text"]).alias("text"),
            t["role"].isin(*learn).alias("learn"),
        ),
    )
    split = turns.withColumn("parts", parts)
    ends = F.aggregate(
        "parts",
        F.array(F.lit(0).cast("long")),
        lambda ends, p: F.concat(
            ends, F.array(F.element_at(ends, -1) + F.length(p["head"]) + F.length(p["text"]) + F.lit(len(END)))
        ),
    )
    placed = split.withColumn("ends", ends)
    spans = F.transform(
        "parts",
        lambda p, i: F.struct(
            p["learn"].alias("learn"),
            (F.get("ends", i) + F.length(p["head"])).alias("start"),
            (F.get("ends", i) + F.length(p["head"]) + F.length(p["text"])).alias("end"),
        ),
    )
    return placed.select(
        *[c for c in turns.columns if c not in ("formatted", "loss_spans")],
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["text"], F.lit(END))), "").alias("formatted"),
        F.transform(F.filter(spans, lambda s: s["learn"]), lambda s: s.dropFields("learn")).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text."""
    parts = F.slice(F.split(formatted, END.replace("\n", "\\n")), 1, F.size(F.split(formatted, END.replace("\n", "\\n"))) - 1)

    def turn(part: Column) -> Column:
        role = F.substring_index(F.substr(part, F.lit(len(BEGIN) + 1)), SAYS, 1)
        return F.struct(
            unescape(role, _ROLE_ESCAPES).alias("role"),
            unescape(F.substr(part, F.length(role) + F.lit(len(BEGIN) + len(SAYS) + 1))).alias("text"),
        )

    return F.transform(parts, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    taken = F.transform(spans, lambda s: F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return F.array_join(F.transform(taken, lambda part: unescape(part)), "")
