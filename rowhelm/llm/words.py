"""Words, shingles and their hashes for whole Arrow batches of texts, without a loop over words.

Hashes are polynomial over 64-bit integers with random byte codes, so the hash of any span is a
difference of two prefix sums; a final mix spreads the bits. Equal spans have equal hashes in every
task. Texts are handled in slices of about ``SLICE`` bytes, which bounds the memory whatever the
batch; one longer text is one slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240601)
CODES = _rng.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = [0x9E3779B97F4A7C13, 0xC2B2AE3D27D4EB4B]  # both are 3 modulo 8
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(which: int, n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of a base, or of its inverse, modulo 2**64."""
    have = _powers.get((which, inverse))
    if have is None or len(have) < n:
        base = BASES[which] if not inverse else pow(BASES[which], -1, 1 << 64)
        size = max(n, SLICE + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[which, inverse] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def span_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """Polynomial hash of ``values[start:end]`` for each span, mixed."""
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * powers(which, len(values)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(which, len(values) + 1, inverse=True)[starts])


class Slice:
    """Rows ``first`` to ``last`` of a batch: their bytes, words and hashes."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE):
        self.first, self.data, self.offsets = first, data, offsets
        self.rows = len(offsets) - 1
        white = separators[data]
        before = np.empty_like(white)
        before[:1] = True
        before[1:] = white[:-1]
        after = np.empty_like(white)
        after[-1:] = True
        after[:-1] = white[1:]
        full = np.flatnonzero(np.diff(offsets))
        before[offsets[full]] = True
        after[offsets[full + 1] - 1] = True
        word = ~white
        self.starts = np.flatnonzero(word & before)
        self.ends = np.flatnonzero(word & after) + 1
        #: Words of row r are bounds[r] to bounds[r + 1].
        self.bounds = np.searchsorted(self.starts, offsets)

    def word_hashes(self, which: int = 0, lower: bool = False) -> np.ndarray:
        data = LOWER[self.data] if lower else self.data
        return span_sums(CODES[which][data], self.starts, self.ends, which)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.bounds))


def window_hashes(words: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` words, also of those that cross rows (see ``inside``)."""
    n = max(0, len(words) - size + 1)
    at = np.arange(n)
    return span_sums(words, at, at + size, which)


def inside(bounds: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which windows of ``size`` words lie within one row."""
    ok = np.ones(n, bool)
    # a window that starts within size - 1 words before a row's end leaves the row
    ends = bounds[1:]
    for back in range(1, size):
        at = ends - back
        at = at[(at >= bounds[:-1]) & (at < n)]
        ok[at] = False
    return ok


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a text column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, size: int = SLICE, separators: np.ndarray = WHITE) -> Iterator[Slice]:
    data, offsets = text_buffers(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        yield Slice(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], separators)
        first = last
