"""Reading Arrow batches inside tasks a few megabytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

MAX_ROWS, MAX_BYTES = 1024, 4 << 20


def slices(batches, column: str, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``max_rows`` rows and, but for one long row, ``max_bytes`` of ``column``."""
    for batch in batches:
        at, rows = 0, batch.num_rows
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        while at < rows:
            end, held = at, 0
            while end < rows and end - at < max_rows and (end == at or held + int(sizes[end]) <= max_bytes):
                held += int(sizes[end])
                end += 1
            yield batch.slice(at, end - at)
            at = end


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The names ``wanted``, each with as many underscores before it as it takes to be free."""
    used = {name.lower() for name in taken}
    found = []
    for name in wanted:
        while name.lower() in used:
            name = f"_{name}"
        found.append(name)
    return found


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; a null is empty."""
    return column.cast(pa.large_binary()).fill_null(b"").to_pylist()
