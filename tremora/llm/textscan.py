"""Vectorised scans of Arrow string columns: slices of bounded size, word bounds, word hashes.

Every operator of this subpackage that reads words goes through here. A word is
``[^\\x20\\x09-\\x0D]+``; these separators are single bytes in UTF-8, so bounds can be found on bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Small enough for the arrays of a slice to stay in a core's cache, and for a worker to stay small.
SLICE_BYTES = 256 << 10

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse. Tables for very long texts are not kept."""
    if "up" not in _powers or len(_powers["up"]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        found = {}
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(max(n, 1 << 16), base, dtype=U)
            steps[0] = 1
            found[name] = np.multiply.accumulate(steps)
        if n > 1 << 21:
            return found["up"], found["down"]
        _powers.update(found)
    return _powers["up"], _powers["down"]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null counts as an empty text."""
    if column.null_count:
        column = column.fill_null(
            b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else ""
        )
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[
        column.offset : column.offset + len(column) + 1
    ].astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), offsets - offsets[0]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of the column at most, or a single row."""
    if not batch.num_rows:
        return
    _, offsets = text_buffers(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


class Words:
    """Words of a slice in order. start and end are byte positions, doc is the row in the slice. ``outside`` tells the
    bytes between words; it is white space unless given.
    """

    def __init__(
        self,
        data: np.ndarray,
        offsets: np.ndarray,
        lower: bool = False,
        hashes: bool = True,
        outside: np.ndarray = IS_SPACE
    ):
        n, rows = len(data), len(offsets) - 1
        inside = ~outside[data]
        first = np.zeros(n + 1, dtype=bool)
        first[offsets[:-1]] = True  # a text ends the word before it
        first = first[:n]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | first[1:]
        self.start = np.flatnonzero(begins)
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | first[1:]
        self.end = np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.first = np.searchsorted(self.start, offsets[:-1])
        self.count = np.bincount(self.doc, minlength=rows) if len(self.doc) else np.zeros(rows, dtype=np.int64)
        self.inside = inside
        if hashes:
            self.hash = span_hashes(LOWER[data] if lower else data, self.start, self.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: equal spans get equal hashes wherever they stand."""
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``width`` consecutive word hashes; position i covers words i to i + width - 1."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    out = np.zeros(n, dtype=U)
    for k in range(width):
        out = mix(out * U(0x2545F4914F6CDD1D) + words[k : k + n] + U(k))
    return out


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def array_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    for part in slices(pa.record_batch([column], names=["x"]), "x", limit):
        yield part.column(0)


def give_back() -> None:
    """Return memory that is free again to the system: a worker lives on for other stages beside a large heap."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def code_point_ranks(data: np.ndarray) -> np.ndarray:
    """ranks[i]: code points that begin before byte i."""
    ranks = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=ranks[1:])
    return ranks
