"""Substring dedup: drop words of passages that have occurred before, by a count-min prefilter.

A window is ``size`` consecutive words of one document. A word goes if a window that covers it has
the same words as a window that starts earlier: in a document with a smaller id, or before it in the
same document. All windows are judged on the input.

1. Each window is represented by its anchor, the run of ``size // 2`` words with the smallest hash
   in it. Equal windows have equal anchors at the same place, so an anchor occurs at least as often
   as any of its windows. The tasks' count-min sketches of anchors are merged.
2. A second pass keeps the windows whose anchor is estimated to occur twice; no repeated window is
   lost, since estimates are never too low. Windows met again within a task are settled there, so a
   passage that is everywhere costs one row a task. The rest is grouped exactly, by the anchor's
   64-bit and the window's own 64-bit hash (two independent ones), over whole groups. Windows that
   share a very common anchor but little else are dealt out by their own hash instead.
3. What goes is joined to the documents by id and text hash.

Nulls and empties: a null or empty text has no words (sha256 of nothing). A null id sorts before all
others and stays null. Rows that share an id but not their text come in the order of their text
hash; rows that repeat id and text are the same document, so neither removes the other's words. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowhelm.llm import sketch
from rowhelm.llm.words import Slice, inside, slices, window_hashes

SIZE = 20
CHUNK = 1 << 20
BYTES_PER_WORD = 6


def _anchors(part: Slice, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start word of each window, position of its anchor, hashes of all anchors' runs)."""
    gram = size // 2
    grams = window_hashes(words, gram)
    n = len(words) - size + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, grams
    # leftmost smallest of `reach` neighbours, by doubling
    reach = size - gram + 1
    low, at, have = grams, np.arange(len(grams), dtype=np.int32), 1
    while have < reach:
        step = min(have, reach - have)
        left, right = low[:-step], low[step:]
        take = right < left
        at = np.where(take, at[step:], at[:-step])
        low = np.where(take, right, left)
        have += step
    starts = np.flatnonzero(inside(part.bounds, size, n))
    return starts, at[starts], grams


def _changes(anchor: np.ndarray) -> np.ndarray:
    """Where a new anchor begins in a list of anchors in order."""
    return np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, np.int64)


def _repeated(keys: list[np.ndarray], order: list[np.ndarray]) -> np.ndarray:
    """True for each item whose keys stand earlier in ``order``; equal places count as one."""
    by = np.lexsort([*order[::-1], *keys])
    new = np.zeros(len(by), bool)
    new[:1] = True
    for key in keys:
        k = key[by]
        new[1:] |= k[1:] != k[:-1]
    lead = by[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = np.zeros(len(by), bool)
    for column in order:
        later |= column[by] != column[lead]
    out = np.empty(len(by), bool)
    out[by] = later
    return out


def _candidates(size: int, counters, heavy) -> callable:
    names = ["anchor", "doc_id", "text_key", "start", "todo", "done", "hashes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def flush():
            doc, key, start, anchor, own, place, hot = (np.concatenate([h[i] for h in held]) for i in range(7))
            settled = _repeated([own, anchor], [doc, key, start])
            # one row for each anchor's place: its windows start at `first` and follow each other
            new = np.concatenate([[True], hot[1:] | (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1) | (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])
            head = np.flatnonzero(new)
            bit = np.left_shift(1, start - start[head][np.cumsum(new) - 1])
            done = np.add.reduceat(np.where(settled, bit, 0), head)
            todo = np.add.reduceat(np.where(settled, 0, bit), head)
            counts = np.add.reduceat((~settled).astype(np.int64), head)
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32) * 8
            left = own[~settled]
            spread = np.where(todo == 0, own[head], anchor[head]).view(np.int64)
            blob = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(left))])
            table = pa.RecordBatch.from_arrays(
                [pa.array(spread), pa.array(doc[head]), pa.array(key[head]), pa.array(start[head].astype(np.int32)), pa.array(todo.astype(np.int32)), pa.array(done.astype(np.int32)), blob], names
            )
            for at in range(0, len(head), 50_000):
                yield table.slice(at, 50_000)

        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for part in slices(batch.column(2)):
                words = part.word_hashes()
                starts, anchor, grams = _anchors(part, words, size)
                new = _changes(anchor)
                if not len(new):
                    continue
                often = sketch.estimate(counters.value, grams[anchor[new]]) >= 2
                keep = np.repeat(often, np.diff(np.append(new, len(anchor))))
                starts, anchor = starts[keep], anchor[keep]
                if not len(starts):
                    continue
                row = np.searchsorted(part.bounds, starts, side="right") - 1
                own = window_hashes(words, size, 1)[starts]
                lead = grams[anchor]
                hot = sketch.among(heavy.value, lead) >= 0
                if hot.any():
                    lead, own = np.where(hot, own, lead), np.where(hot, window_hashes(words, size)[starts], own)
                held.append((ids[part.first + row], keys[part.first + row], starts - part.bounds[row], lead, own, anchor, hot))
                n += len(starts)
                if n >= CHUNK:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    return run


def _first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of their anchors: which windows have occurred before. Whole groups at a time."""

    def settle(table: pa.Table) -> pa.RecordBatch:
        anchor, doc, key, start, todo, done = (table.column(i).to_numpy() for i in range(6))
        blob = table.column(6).combine_chunks()
        blob = blob.chunk(0) if isinstance(blob, pa.ChunkedArray) else blob
        bounds = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset : blob.offset + len(blob) + 1] // 8
        data = blob.buffers()[2]
        own = np.frombuffer(data, np.uint64)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint64)
        row = np.repeat(np.arange(len(anchor)), np.diff(bounds))
        bits = (todo[:, None] >> np.arange(31)) & 1
        offset = np.nonzero(bits)[1]
        if len(own):
            again = _repeated([own, anchor[row]], [doc[row], key[row], start[row] + offset])
            done = done + np.bincount(row, np.where(again, 1 << offset, 0), len(done)).astype(np.int32)
        keep = np.flatnonzero(done)
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (doc, key, start.astype(np.int32), done.astype(np.int32))], ["doc_id", "text_key", "start", "gone"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor = batch.column(0).to_numpy()
        cut = int(np.searchsorted(anchor, anchor[-1]))  # the last group may go on
        if cut or held and held[-1].column(0)[-1].as_py() != anchor[0]:
            if cut:
                held.append(batch.slice(0, cut))
            yield settle(pa.Table.from_batches(held))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield settle(pa.Table.from_batches(held))


def _cut(size: int, untouched: bool) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_gone, kept_words = [], [], []
            gone = batch.column(2)
            for text, marks in zip(batch.column(1), gone):
                words = text.as_py().encode().split() if text.is_valid else []
                total = len(words)
                if marks.is_valid:
                    keep = np.ones(total + size, bool)
                    for mark in marks.values.to_pylist():
                        start, bits = mark["start"], mark["gone"]
                        while bits:
                            low = (bits & -bits).bit_length() - 1
                            keep[start + low : start + low + size] = False
                            bits &= bits - 1
                    words = [words[i] for i in np.flatnonzero(keep[:total])]
                n_words.append(total)
                n_gone.append(total - len(words))
                same = untouched and total == len(words) and text.is_valid
                kept_words.append(text.as_py() if same else b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(kept_words, pa.string()), *batch.columns[3:]],
                ["doc_id", "n_words", "n_removed", "kept_text", *batch.schema.names[3:]],
            )

    return run


def removed_windows(docs: DataFrame, size: int = SIZE, max_sketch_bytes: int = sketch.MAX_BYTES) -> DataFrame:
    """doc_id, text_key and, for each anchor's place, where windows start that have occurred before.

    ``start`` is a word position and bit b of ``gone`` marks the window at ``start + b``. Null ids are
    the smallest long here. Runs the sketching job when called.
    """
    if not 2 <= size <= 40:
        raise ValueError("size must be 2 to 40 words")
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.xxhash64("text").alias("text_key"), "text"
    )
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def anchors_of(batch):
        for part in slices(batch.column(0)):
            _, anchor, grams = _anchors(part, part.word_hashes(), size)
            if len(anchor):
                yield grams[anchor[_changes(anchor)]]

    cells = sketch.cells_for(total // BYTES_PER_WORD // max(1, size // 4), 8, max_sketch_bytes)
    counters, items, _ = sketch.build(texts.select("text"), anchors_of, cells)
    context = docs.sparkSession.sparkContext
    counters, heavy = context.broadcast(counters), context.broadcast(items)
    rows = texts.mapInArrow(
        _candidates(size, counters, heavy), "anchor long, doc_id long, text_key long, start int, todo int, done int, hashes binary"
    )
    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
        _first_seen, "doc_id long, text_key long, start int, gone int"
    )


def remove_repeats(docs: DataFrame, size: int = SIZE, max_sketch_bytes: int = sketch.MAX_BYTES, untouched: bool = False) -> DataFrame:
    """The documents (other columns kept) with ``n_words``, ``n_removed`` and ``kept_text``.

    ``kept_text`` is the remaining words joined by one space; with ``untouched``, texts that lose
    nothing keep their white space. Columns of those names, if the input
    has them, are replaced.
    """
    gone = (
        removed_windows(docs, size, max_sketch_bytes)
        .groupBy("doc_id", "text_key")
        .agg(F.collect_list(F.struct("start", "gone")).alias("_gone"))
        .withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    )
    own = ("doc_id", "text", "n_words", "n_removed", "kept_text", "_gone", "_id", "_key")
    rest = [c for c in docs.columns if c.lower() not in own]
    base = docs.select(
        "doc_id", "text", *rest, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_id"), F.xxhash64("text").alias("_key")
    )
    joined = base.join(gone, ["_id", "_key"], "left").select("doc_id", "text", "_gone", *rest)
    kinds = {f.name: f.dataType.simpleString() for f in joined.schema}
    schema = f"doc_id {kinds['doc_id']}, n_words long, n_removed long, kept_text string" + "".join(f", `{c}` {kinds[c]}" for c in rest)
    return joined.mapInArrow(_cut(size, untouched), schema)


def digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple], size: int = SIZE) -> dict:
    """The same by a dictionary of windows, for tests: {doc_id: (n_words, n_removed, sha256)}; ids differ."""
    seen, out = {}, {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        words = (text or "").encode().split()
        drop = [False] * len(words)
        for i in range(len(words) - size + 1):
            window = tuple(words[i : i + size])
            if window in seen:
                drop[i : i + size] = [True] * size
            seen.setdefault(window, (doc_id, i))
        kept = [w for w, d in zip(words, drop) if not d]
        out[doc_id] = (len(words), sum(drop), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out
