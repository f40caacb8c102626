"""CSV files as records: headers by their place, quoted line breaks read by many tasks.

A line's place is (file, block, line): the file's path, the start of the block that a task
reads, and the number of the line in it. The order of places is the order of the files' lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimspark.functions.scratch import materialise

QUOTE = '"'
PLACE = "_place"
PLACE_TYPE = "struct<file: string, block: bigint, line: bigint>"


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(value, file, block): the lines of text files, in order within a block."""
    return spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def literal(file: str, encoded: bool = True) -> str:
    """A file's name, by default as ``_metadata`` has it, as a path that matches this file only."""
    return re.sub(r"([\\\[\]{}*?,])", r"\\\1", unquote(file) if encoded else file)


def headers(spark: SparkSession, paths: str | list[str]) -> dict[str, str]:
    """The first line that is not blank of each file, known by its place: the start of the block at 0.

    One job; a task for each block, which ends after the first few lines of a first block and
    at once elsewhere. What comes back is a line for each file (Spark itself holds the files'
    names on the driver); files without lines have none.
    """
    def first(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.column("block")[0].as_py():
                return
            for n, value in enumerate(batch.column("value").to_pylist()):
                if value.strip(" "):
                    yield batch.select(["value", "file"]).slice(n, 1)
                    return

    side = spark.newSession()  # settings of its own: no task has two files, and batches are small
    side.conf.set("spark.sql.files.openCostInBytes", spark.conf.get("spark.sql.files.maxPartitionBytes"))
    side.conf.set("spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes"))
    side.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 32)
    found = lines(side, paths).mapInArrow(first, "value string, file string").collect()
    return {row["file"]: row["value"] for row in found}


def odd_quotes(column: str) -> "F.Column":
    """Whether a line has an odd number of quotes, so that a quoted value stays open in it."""
    line = F.col(column)
    return F.contains(line, F.lit(QUOTE)) & ((F.length(line) - F.length(F.replace(line, F.lit(QUOTE)))) % 2 == 1)


def placed_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(value, _place): each line a record, whatever its quotes."""
    number = F.monotonically_increasing_id()  # rises in the order in which a block is read
    place = F.struct("file", "block", number.alias("line")).alias(PLACE)
    return lines(spark, paths).select("value", place)


def placed_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(value, _place): records, which may hold line breaks in quoted values; the place is that of the first line.

    Whether a block begins inside a quoted value follows from the quotes in all blocks before
    it: one scan adds them up for each block, a running sum over the blocks (a row each) gives
    the parity at each block's start, and then every block is cut into records on its own.
    Records that run over a border are few; their pieces are stored and put together. So a
    file is read by as many tasks as it has blocks.

    Line breaks in values become line feeds. A file whose quotes do not close in the end has
    no way to tell values from lines; its lines are records each, and those with an open quote
    are bad.
    """
    source = lines(spark, paths)
    open_line = odd_quotes("value").cast("long")
    blocks = source.groupBy("file", "block").agg(F.sum(open_line).alias("quotes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    # a record that is open at the start of a block began in the last block before it that has an odd line
    opened = F.last(F.when(F.col("quotes") > 0, F.col("block")), ignorenulls=True).over(before)
    judged = blocks.select(
        "file", "block",
        (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"),
        (F.sum("quotes").over(whole) % 2 == 1).alias("unbalanced"),
        opened.alias("opened"),
    )
    # only blocks that begin inside a value, or of files that do not close: at most a row a block
    odd = judged.where("inside or unbalanced").collect()
    unbalanced = {row["file"] for row in odd if row["unbalanced"]}
    inside = {(row["file"], row["block"]): row["opened"] for row in odd if row["inside"] and row["file"] not in unbalanced}

    def cut(batches) -> Iterator[pa.RecordBatch]:
        own, state = None, None
        for batch in batches:
            files, starts = batch.column("file"), batch.column("block").to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                same = starts[at:] == starts[at]
                end = at + (int(same.argmin()) if not same.all() else len(same))
                # two files' blocks may begin at the same number
                name = files[at].as_py()
                if files[end - 1].as_py() != name:
                    end = at + pc.index(pc.not_equal(files.slice(at, end - at), name), pa.scalar(True)).as_py()
                key = (name, int(starts[at]))
                if key != own:
                    if state is not None:
                        yield from state.close()
                    own, state = key, _Block(*key, key in inside, inside.get(key), name in unbalanced)
                yield from state.add(batch.column("value").slice(at, end - at))
                at = end
        if state is not None:
            yield from state.close()

    cut_lines = source.mapInArrow(cut, f"value string, part long, {PLACE} {PLACE_TYPE}")
    done = cut_lines.where("part is null").select("value", PLACE)
    if not inside:
        return done
    cross = {file for file, _ in inside}
    some = lines(spark, [literal(file) for file in sorted(cross)]).mapInArrow(cut, f"value string, part long, {PLACE} {PLACE_TYPE}").where("part is not null")
    pieces = materialise(some.select("value", "part", PLACE), "record_pieces")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(f"{PLACE}.block").alias("block"), PLACE, "value")))
    joined = pieces.groupBy(F.col(f"{PLACE}.file").alias("file"), "part").agg(ordered.alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["value"]), "\n")
    return done.unionByName(joined.select(text.alias("value"), F.col("parts")[0][PLACE].alias(PLACE)))


class _Block:
    """The records of one block, from its lines in order."""

    def __init__(self, file: str, block: int, inside: bool, opened: int | None, by_line: bool) -> None:
        self.file, self.block, self.by_line = file, block, by_line
        self.line = 0
        #: Lines of the record that is open, where it began, and the block that its pieces meet under.
        self.held: list[str] | None = [] if inside else None
        self.began, self.part = 0, opened

    def add(self, values: pa.Array) -> Iterator[pa.RecordBatch]:
        number = len(values)
        if self.by_line:
            yield self._batch(values, None, np.arange(self.line, self.line + number))
            self.line += number
            return
        quotes = pc.count_substring(values, QUOTE).to_numpy(zero_copy_only=False) & 1
        after = (np.cumsum(quotes) + (self.held is not None)) & 1
        before = after ^ quotes
        whole = (before | after) == 0
        yield self._batch(values.filter(pa.array(whole)), None, self.line + np.flatnonzero(whole))
        for n in np.flatnonzero(~whole).tolist():
            text = values[n].as_py()
            if not before[n]:
                self.held, self.began, self.part = [text], self.line + n, None
                continue
            self.held.append(text)
            if not after[n]:
                yield self._piece(self.part)
                self.held = None
        self.line += number

    def close(self) -> Iterator[pa.RecordBatch]:
        """What is open at the end of the block goes on in the next."""
        if self.held:
            yield self._piece(self.block if self.part is None else self.part)
        self.held = None

    def _piece(self, part: int | None) -> pa.RecordBatch:
        return self._batch(pa.array(["\n".join(self.held)]), part, np.array([self.began]))

    def _batch(self, values: pa.Array, part: int | None, line: np.ndarray) -> pa.RecordBatch:
        number = len(values)
        place = pa.StructArray.from_arrays(
            [pa.array([self.file] * number, pa.string()), pa.array(np.full(number, self.block)), pa.array(line.astype(np.int64))],
            names=["file", "block", "line"],
        )
        parts = pa.array([part] * number, pa.int64())
        return pa.RecordBatch.from_arrays([values.cast(pa.string()), parts, place], names=["value", "part", PLACE])
