"""Counts over whole texts, by row, for quality rules and the quality classifier."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from rowhelm.llm.words import CODES, WHITE, Slice, inside, mix, slices, span_sums, window_hashes

SYMBOLS = b"#*$%&|<>"
REPEAT = 5
#: The counts, in the order of ``row_counts``.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_short_words", "n_distinct_words"]


def _table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


IS_SYMBOL = _table(SYMBOLS)
IS_UPPER = _table(bytes(range(65, 91)))
IS_DIGIT = _table(b"0123456789")
IS_MARK = _table(b"!?.,;:\"'()[]{}-_/\\@~^+=`")


def by_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set between the bounds of each row."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[bounds])


def again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each key occurs twice or more, whether it has occurred before)."""
    by = np.argsort(keys, kind="stable")
    k = keys[by]
    same = k[1:] == k[:-1]
    twice, before = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    before[by[1:]] = same
    twice[by[1:]] = same
    twice[by[:-1]] |= same
    return twice, before


def row_keys(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hashes made different for different rows."""
    return mix(hashes + (row.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def line_spans(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the lines of each row, split at newlines; an empty row has none."""
    full = np.flatnonzero(np.diff(part.offsets))
    breaks = np.flatnonzero(part.data == 10)
    starts = np.concatenate([part.offsets[full], breaks + 1])
    ends = np.concatenate([part.offsets[full + 1], breaks])
    starts.sort(kind="stable")
    ends.sort(kind="stable")
    # a break at a row's end leaves an empty line at the next row's start, which has no word
    row = np.searchsorted(part.offsets, starts, side="right") - 1
    return starts, np.maximum(starts, ends), np.clip(row, 0, max(0, part.rows - 1))


def row_counts(part: Slice) -> np.ndarray:
    """One row of ``COUNTS`` for each text of the slice."""
    words = part.word_hashes()
    row = part.row_of_word()
    out = np.zeros((part.rows, len(COUNTS)), np.int64)
    out[:, 0] = np.diff(part.bounds)
    data = part.data
    out[:, 1] = by_row(((data & 0xC0) != 0x80) & ~WHITE[data], part.offsets)
    out[:, 2] = by_row(IS_SYMBOL[data], part.offsets)
    starts, ends, line_row = line_spans(part)
    if len(starts):
        filled = np.searchsorted(part.starts, ends) > np.searchsorted(part.starts, starts)
        starts, ends, line_row = starts[filled], ends[filled], line_row[filled]
        _, before = again(row_keys(span_sums(CODES[0][data], starts, ends, 0), line_row))
        out[:, 3] = np.bincount(line_row[before], minlength=part.rows)
        out[:, 5] = np.bincount(line_row, minlength=part.rows)
    windows = window_hashes(words, REPEAT)
    at = np.flatnonzero(inside(part.bounds, REPEAT, len(windows)))
    if len(at):
        twice, _ = again(row_keys(windows[at], row[at]))
        step = np.zeros(len(words) + 1, np.int64)
        hit = at[twice]
        step[hit] += 1  # each start is there once
        np.subtract.at(step, hit + REPEAT, 1)
        out[:, 4] = by_row(np.cumsum(step[:-1]) > 0, part.bounds)
    for column, table in ((6, IS_UPPER), (7, IS_DIGIT), (8, IS_MARK)):
        out[:, column] = by_row(table[data], part.offsets)
    out[:, 9] = by_row(part.ends - part.starts <= 2, part.bounds)
    _, before = again(row_keys(words, row))
    out[:, 10] = by_row(~before, part.bounds)
    return out


def counts_of(column: pa.Array) -> np.ndarray:
    parts = [row_counts(part) for part in slices(column)]
    return np.concatenate(parts) if parts else np.zeros((0, len(COUNTS)), np.int64)


def add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (text, other columns): the other columns, then ``COUNTS``."""
    for batch in batches:
        counts = counts_of(batch.column(0))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[1:], *(pa.array(counts[:, i]) for i in range(len(COUNTS)))], [*batch.schema.names[1:], *COUNTS]
        )
