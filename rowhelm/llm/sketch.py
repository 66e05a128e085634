"""Count-min sketch with small saturating counters, built per task and merged by Spark.

Two rows of counters that stop at 3, four to a byte. Each task sends its non-zero cells, cut into
``SHARDS`` ranges and compressed; the ranges are added up shard by shard while they stream past, so a
merging task holds its shards only. The merged counters (at most ``max_bytes``) go to every task as a
broadcast. An estimate is never below the true count (up to 3). When the items outgrow the bound the
estimates only get coarser: callers pass more items on to their exact step, and lose none.

Beside it come the heavy items: those that make up at least ``1 / share`` of all, found among the
items with that share of some task's part, so at most ``share`` of them. They serve to split or
postpone hot keys; results don't depend on which items are in the list.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowhelm.llm.storage import drop_stored, stored

HEAVY = 1 << 14
SHARDS = 128
PIECES = 8
TOP = 3
MAX_BYTES = 1 << 26
FLUSH = 1 << 20
_ODD = [np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)]


def cells_for(items: int, per_item: float = 4, max_bytes: int = MAX_BYTES) -> int:
    """Number of counters: a power of two, bounded by ``max_bytes`` (four counters a byte)."""
    wanted = 1 << max(16, int(items * per_item - 1).bit_length() if items else 16)
    return min(wanted, max_bytes * 4)


def cells_of(hashes: np.ndarray, cells: int, row: int) -> np.ndarray:
    half = cells // 2
    shift = np.uint64(64 - (half.bit_length() - 1))
    return ((hashes * _ODD[row]) >> shift).astype(np.int64) + row * half


def _pack(hashes: np.ndarray, cells: int) -> Iterator[tuple[int, bytes]]:
    at = np.concatenate([cells_of(hashes, cells, 0), cells_of(hashes, cells, 1)]).astype(np.uint32)
    at.sort()
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, int)
    counts = np.minimum(np.diff(np.append(first, len(at))), TOP).astype(np.uint8)
    at = at[first]
    size = cells // SHARDS
    cut = np.searchsorted(at, np.arange(SHARDS + 1, dtype=np.int64) * size)
    squeeze = zstandard.ZstdCompressor(level=1)
    for shard in range(SHARDS):
        own = at[cut[shard] : cut[shard + 1]]
        if len(own):
            steps = np.diff(own, prepend=np.uint32(shard * size))
            steps = steps.astype(np.uint16) if steps.max() < 65536 else steps
            head = np.array([len(own), steps.itemsize], np.uint32).tobytes()
            yield shard, squeeze.compress(head + steps.tobytes() + counts[cut[shard] : cut[shard + 1]].tobytes())


def _add(into: np.ndarray, blob: bytes) -> None:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, width = np.frombuffer(raw, np.uint32, 2)
    n, width = int(n), int(width)
    steps = np.frombuffer(raw, np.uint16 if width == 2 else np.uint32, n, 8)
    at = np.cumsum(steps.astype(np.int64))
    into[at] = np.minimum(into[at] + np.frombuffer(raw, np.uint8, n, 8 + n * width), TOP)


def build(
    df: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], cells: int, share: int = HEAVY
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(merged counters, heavy hashes in order, their counts) of what ``hashes_of`` gives for ``df``."""

    def partial(batches):
        held, n = [], 0

        def flush():
            hashes = np.concatenate(held)
            rows = list(_pack(hashes, cells))
            hashes.sort()
            first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            counts = np.diff(np.append(first, len(hashes)))
            most = np.flatnonzero(counts >= max(8, len(hashes) // share))
            none = [None] * len(most)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows] + none, pa.int32()), pa.array([r[1] for r in rows] + none, pa.binary()), pa.array([None] * len(rows) + hashes[first[most]].view(np.int64).tolist(), pa.int64()), pa.array([len(hashes)] + [0] * (len(rows) - 1) + counts[most].tolist(), pa.int64())],
                ["shard", "part", "item", "n"],
            )

        for batch in batches:
            for hashes in hashes_of(batch):
                if len(hashes):
                    held.append(hashes)
                    n += len(hashes)
                if n >= FLUSH:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                if shard not in sums:
                    sums[shard] = np.zeros(cells // SHARDS, np.uint8)
                _add(sums[shard], part.as_py())
        for shard, own in sums.items():
            four = own.reshape(-1, 4)
            packed = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([packed.tobytes()], pa.binary())], ["shard", "part"])

    parts = stored(df.mapInArrow(partial, "shard int, part binary, item long, n long"), "sketch")
    counters = np.zeros(cells // 4, np.uint8)
    size = cells // 4 // SHARDS
    sketches = parts.filter("shard is not null").select("shard", "part")
    merged = stored(sketches.repartition("shard").mapInArrow(merge, "shard int, part binary"), "merged")
    for piece in range(PIECES):  # at most max_bytes in all
        for row in merged.filter(F.col("shard") % PIECES == piece).collect():
            counters[row.shard * size : (row.shard + 1) * size] = np.frombuffer(row.part, np.uint8)
    total = parts.filter("shard is not null").agg(F.sum("n")).first()[0] or 0
    heavy = parts.filter("item is not null").groupBy("item").agg(F.sum("n").alias("n"))
    rows = heavy.filter(F.col("n") >= max(8, total // share)).collect()  # at most `share` rows of two longs
    drop_stored(merged)
    drop_stored(parts)
    items = np.array([r.item for r in rows], np.int64).view(np.uint64)
    by = np.argsort(items)
    return counters, items[by], np.array([r.n for r in rows], np.int64)[by]


def among(heavy: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Position of each hash in the ordered ``heavy``, or -1."""
    if not len(heavy):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(heavy, hashes), len(heavy) - 1)
    return np.where(heavy[at] == hashes, at, -1)


def estimate(counters: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Upper bound of each hash's count, 3 standing for 3 or more."""
    cells, low = len(counters) * 4, None
    for row in range(2):
        at = cells_of(hashes, cells, row)
        got = counters[at >> 2] >> ((at & 3) << 1).astype(np.uint8) & np.uint8(3)
        low = got if low is None else np.minimum(low, got)
    return low
