"""Best-fit packing of documents into sequences of ``capacity`` words, with conflicts.

A sequence takes at most one document of a duplicate cluster and ``per_source`` of a source. A
document that is longer than the capacity is cut into full pieces, which are sequences of their own,
and a rest. The rests are dealt by hash into shards of about ``shard_words`` words, so that copies
and a large source are spread evenly; each shard packs its rests, longest first: open bins are
ordered by the room they have left and carry bitmaps of their sources and clusters, and the search
goes on from the tightest bin that has room to the next until one is compatible.

Clusters are equal texts, a column of the documents, or names by (doc_id, text_key) such as the components of
near-duplicates.

Nulls and empties: null or empty text is one piece of 0 words. A null source or cluster conflicts
with nothing. Ties are settled by id. Repeated rows are packed each (equal texts are one cluster, so
not together). An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowhelm.llm.storage import stored
from rowhelm.llm.words import slices

CAPACITY = 2048
PER_SOURCE = 8
SHARD_WORDS = 1 << 21


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [np.diff(part.bounds) for part in slices(batch.column(0))]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[1:], pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64))], [*batch.schema.names[1:], "n"]
        )


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int, per_source: int) -> list[int]:
    """Bin of each item, in the given order."""
    alone = {c for c, n in Counter(clusters).items() if n == 1}
    cluster_bit = {c: 1 << k for k, c in enumerate(dict.fromkeys(c for c in clusters if c is not None and c not in alone))}
    source_at = {s: k * per_source for k, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has r words left
    bin_sources: list[int] = []
    bin_clusters: list[int] = []
    out = []
    full = (1 << per_source) - 1
    for size, source, cluster in zip(sizes, sources, clusters):
        bit = cluster_bit.get(cluster, 0)
        at = source_at.get(source)
        last = 0 if at is None else 1 << (at + per_source - 1)
        rest, left = open_rooms >> size, size
        chosen = -1
        while rest:
            step = (rest & -rest).bit_length() - 1
            left += step
            for place, number in enumerate(room[left]):
                if not (bin_clusters[number] & bit or bin_sources[number] & last):
                    chosen = number
                    break
            if chosen >= 0:
                room[left][place] = room[left][-1]
                room[left].pop()
                if not room[left]:
                    open_rooms ^= 1 << left
                break
            rest >>= step + 1
            left += 1
        if chosen < 0:
            chosen, left = len(bin_sources), capacity
            bin_sources.append(0)
            bin_clusters.append(0)
        bin_clusters[chosen] |= bit
        if at is not None:
            used = bin_sources[chosen] >> at & full
            bin_sources[chosen] |= (used << 1 | 1) << at
        left -= size
        if not room[left]:
            open_rooms |= 1 << left
        room[left].append(chosen)
        out.append(chosen)
    return out


def _pack(capacity: int, per_source: int) -> callable:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "doc_id", "cluster", "first_token"], ascending=[False, True, True, True], kind="stable")
        clean = lambda c: [None if pd.isna(x) else x for x in rows[c].tolist()]
        bins = best_fit(rows["n_tokens"].tolist(), clean("source"), clean("cluster"), capacity, per_source)
        out = rows[["doc_id", "piece", "first_token", "n_tokens"]].copy()
        out["bin"] = [f"s{shard}.{number}" for shard, number in zip(rows["shard"], bins)]
        return out

    return run


def pack(
    docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_words: int = SHARD_WORDS, cluster=None, near: DataFrame | None = None
) -> DataFrame:
    """doc_id, piece, first_token, n_tokens and the bin of each piece. ``cluster``: a column; the text's hash by default.

    ``near``: (doc_id, text_key, component), which goes before ``cluster``; text_key is xxhash64 of the text. Rows
    that aren't in it keep their cluster.
    """
    cluster = F.when(F.octet_length("text") > 0, F.xxhash64("text")) if cluster is None else cluster
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    own = docs.select("text", "doc_id", F.col("source").cast("string").alias("source"), cluster.cast("string").alias("cluster"), F.xxhash64("text").alias("text_key"))
    own = own.mapInArrow(_lengths, f"doc_id {kinds['doc_id']}, source string, cluster string, text_key long, n long")
    sized = stored(own.withColumn("row", F.monotonically_increasing_id()), "sized")
    if near is not None:
        names = near.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.concat(F.lit("near "), "component").alias("_name")).distinct()
        named = sized.join(names, sized["doc_id"].eqNullSafe(F.col("_id")) & (sized["text_key"] == F.col("_key")), "left")
        sized = stored(named.withColumn("cluster", F.coalesce("_name", "cluster")).select(*sized.columns), "clustered")
    total = sized.agg(F.sum(F.col("n") % capacity)).first()[0] or 0
    shards = max(1, -(-int(total) // shard_words))
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("n") / capacity) - 1)))).select(
        "doc_id", "source", "cluster", "row", F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).alias("first_token"),
        F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity).alias("n_tokens"),
    )
    full = F.col("n_tokens") == capacity
    whole = pieces.filter(full).select("doc_id", "piece", "first_token", "n_tokens", F.format_string("w%d.%d", "row", "piece").alias("bin"))
    rests = pieces.filter(~full).withColumn("shard", F.expr(f"pmod(xxhash64(doc_id, row), {shards})")).drop("row")
    packed = rests.groupBy("shard").applyInPandas(
        _pack(capacity, per_source), f"doc_id {kinds['doc_id']}, piece int, first_token long, n_tokens long, bin string"
    )
    return whole.union(packed)
