"""Counts over whole texts, a slice of a partition at a time in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tremora.llm.textscan import U, Words, mix, shingle_hashes, span_hashes, text_buffers


def _signs(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


SYMBOLS = _signs(b"#*$%&|<>")
UPPER = _signs(bytes(range(65, 91)))
LETTERS = _signs(bytes([*range(65, 91), *range(97, 123)]))
DIGITS = _signs(bytes(range(48, 58)))
PUNCTUATION = _signs(bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
REPEAT_WINDOW = 3


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text are flagged."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def base_counts(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, Words]:
    """Counts of each text by name; also the bytes, offsets and words of the slice."""
    data, offsets = text_buffers(column)
    rows = len(column)
    words = Words(data, offsets)
    out = {"n_words": words.count.astype(np.int64)}
    out["word_chars"] = _sums(words.inside & ((data & 0xC0) != 0x80), offsets)
    out["n_symbols"] = _sums(SYMBOLS[data], offsets)

    feed = data == 0x0A
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[1:] = feed
    begins[offsets[:-1]] = True
    starts = np.flatnonzero(begins[: len(data)])
    ends = np.concatenate((starts[1:], [len(data)])) if len(starts) else starts
    ends = ends - (feed[ends - 1] if len(ends) else 0)
    inside = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(words.inside, out=inside[1:])
    full = inside[ends] > inside[starts]
    starts, ends = starts[full], ends[full]
    row = np.searchsorted(offsets, starts, side="right") - 1
    lines = np.bincount(row, minlength=rows)
    keys = mix(span_hashes(data, starts, ends) + row.astype(U) * U(0x9E3779B97F4A7C15))
    _, first = np.unique(keys, return_index=True)
    out["n_lines"] = lines
    out["n_dup_lines"] = lines - np.bincount(row[first], minlength=rows)

    grams = shingle_hashes(words.hash, REPEAT_WINDOW)
    last = REPEAT_WINDOW - 1
    own = words.doc[: len(grams)]
    whole = own == words.doc[last:] if len(grams) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(whole)
    _, inverse, counts = np.unique(
        mix(grams[at] + own[at].astype(U) * U(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True
    )
    again = at[counts[inverse] > 1]
    repeated = np.zeros(len(words.start), dtype=bool)
    for k in range(REPEAT_WINDOW):
        repeated[again + k] = True
    out["n_repeat_words"] = np.bincount(words.doc[repeated], minlength=rows)
    return out, data, offsets, words


FEATURES = (
    "log_words",
    "mean_word",
    "symbol_rate",
    "dup_line_rate",
    "repeat_rate",
    "distinct_rate",
    "upper_rate",
    "digit_rate",
    "punctuation_rate",
    "wide_rate",
    "space_rate",
    "line_words",
    "pipe_rate",
    "shout_rate",
    "short_rate",
    "stop_rate"
)


def features(column: pa.Array) -> np.ndarray:
    """A row of document statistics for each text; an empty text has zeros."""
    out, data, offsets, words = base_counts(column)
    rows = len(column)
    n = np.maximum(out["n_words"], 1).astype(float)
    chars = np.maximum(_sums((data & 0xC0) != 0x80, offsets), 1).astype(float)
    letters = np.maximum(_sums(LETTERS[data], offsets), 1)
    _, first = np.unique(mix(words.hash + words.doc.astype(U) * U(0x9E3779B97F4A7C15)), return_index=True)
    distinct = np.bincount(words.doc[first], minlength=rows)
    short = np.bincount(words.doc[words.end - words.start <= 3], minlength=rows)
    ends = _sums((data == 0x2E) | (data == 0x3F), offsets)
    columns = (
        np.log1p(out["n_words"]), out["word_chars"] / n, out["n_symbols"] / n, out["n_dup_lines"] / np.maximum(out["n_lines"], 1), out["n_repeat_words"] / n, distinct / n,
        _sums(UPPER[data], offsets) / letters, _sums(DIGITS[data], offsets) / chars, _sums(PUNCTUATION[data], offsets) / chars, _sums(data >= 0xC0, offsets) / chars, 1 - out["word_chars"] / chars,
        np.log1p(n / np.maximum(out["n_lines"], 1)), _sums(data == 0x7C, offsets) / n, _sums(data == 0x21, offsets) / n, short / n, ends / n,
    )
    return np.where((out["n_words"] > 0)[:, None], np.stack(columns, axis=1), 0.0)
