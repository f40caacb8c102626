"""Documents as token sequences of a fixed capacity, packed by linear grouping."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions.scratch import materialise
from claimspark.llm.batches import slices
from claimspark.llm.grouping import best_plan

#: Rows of one rank group.
RANK_ROWS = 2_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: What a word pattern takes for white space: a fixed value (the Unicode property).
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space of at least so many characters is a word of its own to the encoder; its pattern is not tried on it.
SPACE = 10_000
_LONG_SPACE = re.compile(f"[{WHITE}]{{{SPACE},}}")


class Tokens:
    """Ids of texts as little-endian unsigned 32-bit numbers, by a tokenizer file.

    A plain byte-level file (words split by ``SPLIT``, ids in the order of the merges) is
    also what rank-based encoders read; those are several times faster, give the same
    ids, and encode all texts of such a file. Any other file is left to its own library.

    The encoder knows neither added tokens nor very long white space, on which its word
    pattern runs out of stack. Both are cut out first, where words end anyway: an added
    token's content is that token, and white space is one word but for its last character,
    which belongs to the word that follows.
    """

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        ranks = _ranks(held)
        self.added = {added["content"]: added["id"] for added in held.get("added_tokens", [])}
        self.parted = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.ranked = None
        if ranks:
            import tiktoken

            self.ranked = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def tokenizer(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(self._ids(text), "<u4").tobytes() for text in texts]

    def _ids(self, text: str) -> list[int]:
        if not self.ranked:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        if not self.parted or not self.parted.search(text):
            return self._words(text)
        parts = self.parted.split(text)
        return [i for part in parts for i in ([self.added[part]] if part in self.added else self._words(part))]

    def _words(self, text: str) -> list[int]:
        if len(text) < SPACE:
            return self.ranked.encode_ordinary(text)
        ids, at = [], 0
        for run in _LONG_SPACE.finditer(text):
            end = run.end() - (run.end() < len(text))
            ids += self.ranked.encode_ordinary(text[at : run.start()])
            ids += self.ranked._encode_single_piece(text[run.start() : end])
            at = end
        return ids + self.ranked.encode_ordinary(text[at:])


#: How byte-level files split a text into words: a fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def _ranks(file: dict) -> dict[bytes, int] | None:
    """The vocabulary as ranks, if the file is a plain byte-level one."""
    model, before = file["model"], file.get("pre_tokenizer") or {}
    plain = {"dropout": None, "byte_fallback": False, "ignore_merges": False, "continuing_subword_prefix": None, "end_of_word_suffix": None}
    if model.get("type", "BPE") != "BPE" or file.get("normalizer") or any(before.get(k) != v for k, v in _BYTE_LEVEL.items()):
        return None
    if any(model.get(k) not in (v, None, "") for k, v in plain.items()):
        return None
    flags = ("single_word", "lstrip", "rstrip", "normalized")
    if any(added[flag] for added in file.get("added_tokens", []) for flag in flags):
        return None  # such a token is more than its content
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged):
        return None
    # printable bytes stand for themselves, the others for characters from 256 on, in order
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}
    special = {added["content"] for added in file.get("added_tokens", []) if added["special"]}
    return {bytes(byte[c] for c in token): rank for token, rank in model["vocab"].items() if token not in special}


@cache
def _tokens(path: str) -> Tokens:
    return Tokens(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, keep_ids: bool = False) -> DataFrame:
    """The pieces of each document: its ids and a closing 0, cut where longer than ``capacity``.

    Only the first piece of a cut document may be shorter. With ``keep_ids`` the ids
    come along as little-endian unsigned 32-bit numbers.
    """
    schema = PIECES + (", ids binary" if keep_ids else "")

    def work(batches) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(tokenizer)
        for batch in slices(batches, "text"):
            rows = []
            texts = [text or "" for text in batch.column("text").to_pylist()]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), tokens.encode(texts)):
                ids += b"\0\0\0\0"
                size = len(ids) // 4
                bounds = [0, *range(size % capacity or capacity, size + 1, capacity)]
                for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    own = ids[4 * a : 4 * b]
                    rows.append((doc, piece, a, b - a, zlib.crc32(own), own)[: 5 + keep_ids])
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            columns = list(zip(*rows)) if rows else [()] * (5 + keep_ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names[: len(columns)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, schema)


def ranked(items: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``items`` with ``rank``: 0, 1, ... among those of equal length, of which there are ``counts``.

    A frequent length is dealt to several groups by a hash of the row; the groups'
    sizes give the rank of the first row of each.
    """
    parts = items.sparkSession.createDataFrame(
        [(length, -(-n // RANK_ROWS)) for length, n in counts.items()] or [(0, 1)], "length long, parts long"
    )
    hashed = F.xxhash64("doc_id", "piece", "start", "ids_crc32")
    salted = items.join(F.broadcast(parts), "length")  # at most as many rows as a sequence has tokens
    salted = salted.withColumn("salt", F.pmod(hashed, F.col("parts"))).drop("parts")
    own = Window.partitionBy("salt", "length").orderBy("doc_id", "piece", "start", "ids_crc32")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy("salt", "length").count()
    first = sizes.select("salt", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    rank = salted.withColumn("place", F.row_number().over(own))
    return (
        rank.join(first, ["salt", "length"])
        .withColumn("rank", F.col("first") + F.col("place") - 1)
        .drop("salt", "first", "place")
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, groups: int = 96, keep_ids: bool = False) -> DataFrame:
    """``docs`` (doc_id, text) in as few sequences of ``capacity`` tokens as the plan finds.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset (and ids
    with ``keep_ids``), one row for each piece. The documents are read and tokenized
    once; the plan is made from the counts of each length, of which there are at most
    ``capacity``, and goes to the tasks with them.

    A null text counts as empty: one piece that holds the closing 0 only. A very long text
    is tokenized whole in its row's task and cut into pieces. A null doc_id stays null;
    repeated rows are packed each, in any order among them; other columns, whatever their
    names, are left out. An empty table gives an empty result.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    items = materialise(pieces(docs, tokenizer, capacity, keep_ids), "pieces")
    counts = {row["length"]: row["count"] for row in items.groupBy("length").count().collect()}
    plan = best_plan(counts, capacity, groups)
    rows = np.array(sorted(plan.rows), np.int64).reshape(-1, 6)
    keys = rows[:, 0] << 40 | rows[:, 1]

    def work(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            own = rows[np.searchsorted(keys, length << 40 | rank, side="right") - 1]
            place = rank - own[:, 1]
            sequence, offset = own[:, 3] + place // own[:, 5], own[:, 4] + length * (place % own[:, 5])
            kept = [name for name in batch.schema.names if name != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in kept), pa.array(sequence), pa.array(offset)],
                names=[*kept, "sequence_id", "offset"],
            )

    schema = PIECES + (", ids binary" if keep_ids else "") + ", sequence_id long, offset long"
    columns = [name for name in items.columns] + ["rank"]
    return ranked(items, counts).select(*columns).mapInArrow(work, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """One row for each sequence of ``pack(..., keep_ids=True)``: its ids, and the documents in it.

    A sequence has at most ``capacity`` pieces, so a group is bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    return (
        packed.groupBy("sequence_id")
        .agg(parts.alias("parts"))
        .select(
            "sequence_id",
            F.aggregate("parts", F.lit(b""), lambda ids, part: F.concat(ids, part["ids"])).alias("ids"),
            F.transform("parts", lambda part: part.dropFields("ids")).alias("documents"),
        )
    )
