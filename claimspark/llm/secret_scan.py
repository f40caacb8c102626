"""Secrets in texts, found by one automaton for all rules in one pass over the bytes."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import cache
from itertools import accumulate
from operator import getitem, itemgetter
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.llm.automaton import Automaton
from claimspark.llm.batches import as_bytes, free_names, slices

#: name: (expression, either letter case). The first three are fixed values; lengths
#: that do not change where a match ends stand in the expression, so that short runs
#: are no matches at all.
RULES: dict[str, tuple[str, bool]] = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", True),
    "access": (r"AKIA[A-Z0-9]{14,}", False),
    "hex": (r"[0-9a-f]{16,}", False),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-+", False),
}
BASE = ("assign", "access", "hex")
#: The value of an assignment, and how long it must be.
VALUE = re.compile(rb"""[A-Za-z_]+["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
VALUE_LENGTH = 12

SPANS = "array<struct<start:long,kind:string,end:long>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))


class Scanner:
    """Finds the spans of all rules in one text."""

    def __init__(self, rules: Mapping[str, tuple[str, bool]]) -> None:
        self.automaton = Automaton(rules)
        table, tags = self.automaton.table.tolist(), self.automaton.tags.tolist()
        # A state is a row of references to rows, its tag at the end: following it needs no arithmetic.
        self.rows = [[None] * len(row) + [tag] for row, tag in zip(table, tags)]
        for row, targets in zip(self.rows, table):
            row[: len(targets)] = [self.rows[t] for t in targets]
        self.first, self.tag = self.rows[self.automaton.first], itemgetter(len(table[0]))
        self.classes = self.automaton.classes.tobytes()
        self.touched = re.compile(b"[^\0]+")

    def tagged(self, data: bytes, state: list) -> tuple[bytes, list]:
        """A tag for each byte, and the state behind the last."""
        states = list(accumulate(data.translate(self.classes), getitem, initial=state))
        return bytes(map(self.tag, states[1:])), states[-1]

    def spans(self, data: bytes, piece: int = 1 << 16) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, by rule and start; a long text is followed piece by piece."""
        state, tags = self.first, []
        for at in range(0, len(data), piece):
            some, state = self.tagged(data[at : at + piece], state)
            tags.append(some)
        tags = b"".join(tags)
        ends: dict[int, list[int]] = {}
        for run in self.touched.finditer(tags):
            for rule in range(len(self.automaton.names)):
                bit, low, high = 1 << rule, *run.span()
                for at in range(low, high):
                    if tags[at] & bit and not (at + 1 < high and tags[at + 1] & bit):
                        ends.setdefault(rule, []).append(at + 1)
        found = []
        for rule, places in ends.items():
            low = 0
            for end in places:
                found.append((self.automaton.start_of(rule, data, low, end), rule, end))
                low = end
        return found

    def find(self, data: bytes) -> list[tuple[int, str, int]]:
        """(start, kind, end) in code points, by start and the order of the rules."""
        kept = [span for span in self.spans(data) if self.automaton.names[span[1]] != "assign" or _long_value(data, span)]
        kept.sort()
        places, at, chars = {}, 0, 0
        for place in sorted({p for span in kept for p in (span[0], span[2])}):
            chars += len(data[at:place].decode("utf-8", "replace"))
            places[place], at = chars, place
        return [(places[a], self.automaton.names[rule], places[b]) for a, rule, b in kept]


def _long_value(data: bytes, span: tuple[int, int, int]) -> bool:
    value = VALUE.match(data, span[0], span[2])
    return bool(value) and len(value[1]) >= VALUE_LENGTH


@cache
def _scanner(rules: tuple) -> Scanner:
    return Scanner(dict(rules))


def scan(docs: DataFrame, text: str = "text", rules: Mapping[str, tuple[str, bool]] = RULES) -> DataFrame:
    """``docs`` with ``spans``: array of (start, kind, end), by start, then by the order of the rules.

    Offsets count code points, the end is exclusive. A null or empty text has no
    spans; repeated rows give repeated results; an empty table gives an empty one.
    Columns of ``docs`` are kept and one called ``spans`` is replaced. There is no
    shuffle, and a task holds 4 MB of text, or one long text, at a time.
    """
    names = tuple(sorted(rules)) if rules is not RULES else tuple(rules)
    frozen = tuple((name, rules[name]) for name in names)
    docs = docs.drop("spans")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"spans {SPANS}"])

    def work(batches) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(frozen)
        for batch in slices(batches, text):
            spans = [
                [{"start": a, "kind": kind, "end": b} for a, kind, b in scanner.find(data)]
                for data in as_bytes(batch.column(text))
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(spans, _SPAN)], names=[*batch.schema.names, "spans"]
            )

    return docs.mapInArrow(work, schema)


def redact(docs: DataFrame, text: str = "text", rules: Mapping[str, tuple[str, bool]] = RULES) -> DataFrame:
    """``docs`` with each secret in the text replaced by ``[SECRET]``; overlapping spans are replaced once.

    Texts without secrets, null and empty ones among them, stay as they are. A column
    ``n_chars`` is set to the length of a text that changed. Repeated rows stay repeated, a
    long text is searched whole, an empty table gives an empty result, and all columns,
    whatever their names, keep their order and types.
    """
    frozen = tuple((name, rules[name]) for name in rules)
    schema = docs.schema

    def work(batches) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(frozen)
        for batch in slices(batches, text):
            place = batch.schema.get_field_index(text)
            column = batch.column(place)
            clean = [
                None if value is None else cut(value, scanner.find(value.encode())) for value in column.to_pylist()
            ]
            yield batch.set_column(place, batch.schema.field(place), pa.array(clean, column.type))

    if "n_chars" not in docs.columns:
        return docs.mapInArrow(work, schema)
    before = F.crc32(text)  # a text of the same checksum and length has not changed
    (mark,) = free_names(docs.columns, "before")
    marked = docs.withColumn(mark, F.struct(before.alias("crc"), F.length(text).alias("chars")))
    names, schema = docs.columns, marked.schema
    same = F.col(mark).eqNullSafe(F.struct(F.crc32(text).alias("crc"), F.length(text).alias("chars")))
    size = F.when(same, F.col("n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return marked.mapInArrow(work, schema).withColumn("n_chars", size).select(*names)


def cut(text: str, spans: list[tuple[int, str, int]], mark: str = "[SECRET]") -> str:
    """``text`` with the spans, sorted by start, replaced by ``mark``."""
    parts, at = [], 0
    for start, _, end in spans:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])
