"""Which sets may have a partner, by counting their hashes exactly in shards: nothing is broadcast or sent to the driver.

Each task gathers sets in groups and sends the hashes of a group, with the number of the set that has them, as one
compressed posting list for each shard (a range of hashes). Then

1. a shard counts its hashes and answers, for each group, how many of a set's hashes are how frequent;
2. a group adds up the answers of all shards and finds where the ``first`` rarest hashes of each set end: a
   level of frequency, and how many hashes of that level in each shard. Sets whose rarest hashes are all seen once end here;
3. a shard links the sets that have one of these hashes in common, by one link for each set: to the smallest that it
   reaches in this shard.

The order of hashes is the same for all sets: seen once, by level of frequency, by hash; and hashes that not
all sets send, by hash. ``COUNTED`` hashes are sent by every set that has them; a set that has too few of these sends
its next ones as well, and they all are among its first.

Hashes are cut to ``BITS`` bits. Equal ones stay equal, so no link is lost; different ones may meet, which only lets
more sets through. What a task holds is bounded by the size of a group or shard, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowhelm.llm.storage import drop_stored, stored

#: Hashes below this are sent by all sets that have them: two of five.
COUNTED = np.uint64((1 << 64) // 5 * 2)
#: Hashes and sets of a group, and hashes of a shard if all were sent.
GROUP = 1 << 21
GROUP_SETS = 1 << 16
SHARD = 1 << 21
LEAST_SHARDS = 16
BITS = 38
#: A set's number is its group's, moved by so many bits, and its place in the group.
PLACE_BITS = 24
#: Counts from which the levels of frequency begin, after those of 2.
LEVELS = np.array([3, 4, 8, 32, 256, 4096])
N_LEVELS = len(LEVELS) + 1


def shards_for(hashes: int) -> int:
    return max(LEAST_SHARDS, -(-hashes // SHARD))


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, byte by byte of all their numbers, so that high bytes take no room."""
    out = [np.array([len(arrays)], np.uint32).tobytes()]
    for x in arrays:
        x = x.astype(np.min_scalar_type(int(x.max())) if len(x) else np.uint8)
        out += [np.array([len(x), x.itemsize], np.uint32).tobytes(), x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def opened(blob: bytes) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 4
    for _ in range(int(np.frombuffer(raw, np.uint32, 1)[0])):
        n, width = (int(v) for v in np.frombuffer(raw, np.uint32, 2, at))
        bytes_ = np.frombuffer(raw, np.uint8, n * width, at + 8).reshape(width, n)
        out.append(np.ascontiguousarray(bytes_.T).view(f"u{width}").reshape(-1).astype(np.int64))
        at += 8 + n * width
    return out


class Group:
    """Sets that a task gathers: ``add`` them slice by slice, and take the rows of ``lists`` when it is ``full``."""

    def __init__(self, number: int, shards: int):
        self.number, self.shards = number, shards
        self.known: set[bytes] = set()
        self.hashes: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.wanting: list[np.ndarray] = []
        self.sets = self.n = 0

    def full(self) -> bool:
        return self.n >= GROUP or self.sets >= GROUP_SETS

    def add(self, hashes: np.ndarray, bounds: np.ndarray, keys: list[bytes], first: np.ndarray) -> np.ndarray:
        """Numbers of the sets, whose ordered hashes are between the bounds. Equal keys stand for equal sets, of which one is sent."""
        size = np.diff(bounds)
        below = np.concatenate([[0], np.cumsum(hashes < COUNTED)])[bounds]
        sent = np.where(size > 0, np.maximum(np.diff(below), first), 0)
        new = np.zeros(len(size), bool)
        for at, key in enumerate(keys):
            new[at] = size[at] > 0 and key not in self.known
            self.known.add(key)
        sent[~new] = 0
        place = np.repeat(np.arange(len(size)), sent)
        within = np.arange(len(place)) - np.repeat(np.cumsum(sent) - sent, sent)
        self.hashes.append(hashes[bounds[place] + within])
        self.places.append(place + self.sets)
        self.wanting.append(np.where(new, sent - first, 0))  # how many more are sent than are among the first
        numbers = (self.number << PLACE_BITS) + self.sets + np.arange(len(size))
        self.sets += len(size)
        self.n += len(place)
        return numbers

    def lists(self) -> tuple[list[int | None], list[bytes]]:
        """(shards, lists); the list without a shard has what each set sends beyond its first."""
        hashes, places = np.concatenate(self.hashes), np.concatenate(self.places)
        by = np.argsort(hashes)
        hashes, places = hashes[by], places[by]
        shard = ((hashes >> np.uint64(32)) * np.uint64(self.shards) >> np.uint64(32)).astype(np.int64)
        cells = hashes >> np.uint64(64 - BITS)
        cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else []
        names, blobs = [None], [squeezed(np.concatenate(self.wanting))]
        for a, b in zip(cut[:-1], cut[1:]):
            names.append(int(shard[a]))
            blobs.append(squeezed(cells[a : a + 1], np.diff(cells[a:b]), places[a:b]))
        return names, blobs


class _Shard:
    """The posting lists of a shard: cell, frequency, group and place of its hashes, ordered by cell."""

    def __init__(self, groups: np.ndarray, blobs: list[bytes]):
        cells, places = [], []
        for blob in blobs:
            lowest, steps, place = opened(blob)
            cells.append(np.cumsum(np.concatenate([lowest, steps])))
            places.append(place)
        lengths = [len(p) for p in places]
        cells, places = np.concatenate(cells), np.concatenate(places)
        numbers = (np.repeat(groups.astype(np.int64), lengths) << PLACE_BITS) + places
        by = np.argsort(cells, kind="stable")  # in a set, hashes of one cell stay in order
        cells, self.numbers = cells[by], numbers[by]
        starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
        counts = np.diff(np.append(starts, len(cells)))
        self.cell = np.repeat(np.arange(len(starts)), counts)
        self.count = np.repeat(counts, counts)
        self._keep(self.count > 1)
        self.level = np.searchsorted(LEVELS, self.count, side="right")

    def _keep(self, these: np.ndarray) -> None:
        self.cell, self.count, self.numbers = self.cell[these], self.count[these], self.numbers[these]


def _frequencies(rows: pd.DataFrame) -> pd.DataFrame:
    own = _Shard(rows["g"].to_numpy(), rows["blob"].tolist())
    keys, counts = np.unique(own.numbers * N_LEVELS + own.level, return_counts=True)
    group = keys // N_LEVELS >> PLACE_BITS
    cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(keys) else []
    shard, out = rows["shard"].iloc[0], []
    for a, b in zip(cut[:-1], cut[1:]):
        codes = keys[a:b] - (group[a] << PLACE_BITS) * N_LEVELS
        out.append((group[a], shard, squeezed(codes[:1], np.diff(codes), counts[a:b])))
    return pd.DataFrame(out, columns=["g", "shard", "blob"])


def _quotas(rows: pd.DataFrame) -> pd.DataFrame:
    """For each shard of a group the sets whose first hashes may be there, the level where they end and how many of that level are among them."""
    head = rows["shard"].isna()
    (beyond,) = opened(rows["blob"][head].iloc[0])
    answers = rows[~head].sort_values("shard")
    parts = []
    for blob in answers["blob"]:
        lowest, steps, counts = opened(blob)
        codes = np.cumsum(np.concatenate([lowest, steps]))
        parts.append((codes // N_LEVELS, codes % N_LEVELS, counts))
    total = np.zeros((len(beyond), N_LEVELS), np.int64)
    for place, level, counts in parts:
        total[place, level] += counts
    need = total.sum(axis=1) - beyond
    upto = np.cumsum(total, axis=1)
    last = np.minimum((upto < need[:, None]).sum(axis=1), N_LEVELS - 1)
    every = np.arange(len(beyond))
    left = need - (upto - total)[every, last]
    out = []
    for shard, (place, level, counts) in zip(answers["shard"], parts):
        ends = (need[place] > 0) & (level == last[place])
        quota = np.zeros(len(place), np.int64)
        quota[ends] = np.clip(left[place[ends]], 0, counts[ends])
        left[place[ends]] -= counts[ends]
        wanted = (need[place] > 0) & ((level < last[place]) | (quota > 0))
        own, at = np.unique(place[wanted], return_inverse=True)
        if len(own):
            most = np.zeros(len(own), np.int64)
            np.maximum.at(most, at, quota[wanted])
            out.append((rows["g"].iloc[0], shard, squeezed(own, last[own], most)))
    return pd.DataFrame(out, columns=["g", "shard", "quota"]).astype({"shard": "int32"})


def least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of the numbers below n that each of them reaches by links between ``a`` and ``b``."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _stars(rows: pd.DataFrame) -> pd.DataFrame:
    sent = rows[rows["quota"].isna()]
    own = _Shard(sent["g"].to_numpy(), sent["blob"].tolist())
    names, lasts, quotas = [], [], []
    for g, blob in rows[rows["quota"].notna()][["g", "quota"]].itertuples(index=False):
        place, last, quota = opened(blob)
        names.append((int(g) << PLACE_BITS) + place)
        lasts.append(last)
        quotas.append(quota)
    names = np.concatenate(names) if names else np.zeros(0, np.int64)
    if not len(names) or not len(own.numbers):
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    by = np.argsort(names)
    names, lasts, quotas = names[by], np.concatenate(lasts)[by], np.concatenate(quotas)[by]
    at = np.minimum(np.searchsorted(names, own.numbers), len(names) - 1)
    known = names[at] == own.numbers
    own._keep(known)
    level, at = own.level[known], at[known]
    taken = level < lasts[at]
    ends = np.flatnonzero(level == lasts[at])
    ends = ends[np.argsort(at[ends], kind="stable")]  # of a set, by cell
    whose = at[ends]
    begins = np.flatnonzero(np.concatenate([[True], whose[1:] != whose[:-1]])) if len(whose) else np.zeros(0, np.int64)
    rank = np.arange(len(whose)) - np.repeat(begins, np.diff(np.append(begins, len(whose))))
    taken[ends[rank < quotas[whose]]] = True
    cell, numbers = own.cell[taken], own.numbers[taken]
    by = np.lexsort((numbers, cell))
    cell, numbers = cell[by], numbers[by]
    new = np.concatenate([[True], cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, bool)
    pivot = numbers[new][np.cumsum(new) - 1]
    names, at = np.unique(np.concatenate([numbers, pivot]), return_inverse=True)
    root = names[least_reached(len(names), at[: len(numbers)], at[len(numbers) :])]
    return pd.DataFrame({"a": names, "b": root})[names != root]


def stars(lists: DataFrame) -> DataFrame:
    """Links (a, b) that join all sets that have one of their first hashes in common, from the ``lists`` (g, shard, blob) of all groups."""
    shared = lists.filter("shard is not null")
    answers = shared.groupBy("shard").applyInPandas(_frequencies, "g long, shard int, blob binary")
    answers = stored(answers, "frequencies")  # which frees the shuffled lists
    quotas = lists.filter("shard is null").unionByName(answers).groupBy("g").applyInPandas(_quotas, "g long, shard int, quota binary")
    quotas = stored(quotas, "quotas")
    drop_stored(answers)
    both = shared.withColumn("quota", F.lit(None).cast("binary")).unionByName(quotas.withColumn("blob", F.lit(None).cast("binary")))
    links = stored(both.groupBy("shard").applyInPandas(_stars, "a long, b long"), "stars")
    drop_stored(quotas)
    return links
