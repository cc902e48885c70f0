"""Ragged results of text units, each distinct unit worked out once per slice and remembered.

Tokenisation never crosses certain bytes (white space, or the start of a run of spaces), so the ids of
a text are those of its units in order. Units are made distinct in Arrow, the distinct ones are looked
up or encoded, and numpy gathers the ids of all occurrences.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Units of one generation that a worker remembers; it keeps two. About 20 MB each.
REMEMBERED = 100_000
#: Longer units are encoded without being remembered.
LONGEST_REMEMBERED = 48
#: Bytes of text whose units are made distinct together.
UNIT_SLICE = 1 << 20


class UnitIds:
    """Ids of units as little-endian bytes of ``dtype``. Units in use stay known: a full generation becomes the older
    one, and what it is asked for moves to the younger.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], dtype: str, remembered: int = REMEMBERED):
        self.encode, self.dtype, self.remembered = encode, np.dtype(dtype), remembered
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def of_distinct(self, units: list[str]) -> list[bytes]:
        young, old = self.young, self.old
        out = [young.get(u) for u in units]
        at = [i for i, x in enumerate(out) if x is None]
        if not at:
            return out
        missing = []
        for i in at:
            unit = units[i]
            if (ids := old.get(unit)) is None:
                missing.append(i)
            else:
                out[i] = young[unit] = ids
        for i, ids in zip(missing, self.encode([units[i] for i in missing]), strict=True):
            out[i] = ids
            if len(units[i]) <= LONGEST_REMEMBERED:
                young[units[i]] = ids
        if len(young) > self.remembered:
            self.young, self.old = {}, young
        return out

    def of_spans(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units in order, number of ids of each unit)."""
        coded = units.dictionary_encode()
        found = self.of_distinct(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // self.dtype.itemsize
        return gather(
            np.frombuffer(b"".join(found), dtype=self.dtype), size, coded.indices.to_numpy(zero_copy_only=False)
        )


def gather(flat: np.ndarray, size: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the runs ``index`` of a ragged array: (values, number of values of each)."""
    counts = size[index]
    begin = (np.cumsum(size) - size)[index]
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(begin - (ends - counts), counts) + np.arange(total)], counts


def string_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))
    )


def per_row(counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the counts of units for each row; ``first`` has the first unit of each row and the number of units."""
    total = np.concatenate(([0], np.cumsum(counts)))
    return total[first[1:]] - total[first[:-1]]
