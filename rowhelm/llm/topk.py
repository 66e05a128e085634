"""Exact top-k inner products by the three-phase uniform threshold method.

The dimensions are cut into ``nodes`` equal parts; each part's inner product is a partial score, and
the score is their sum. Vectors lie in chunks, queries in blocks of bounded size; each task has one
chunk and one block, so neither side is ever whole in one place.

1. Each task gathers the ``k`` best of each part's scores and gives the best totals among these; the
   k-th best total of a query over all chunks is a lower bound of its k-th best score.
2. That cutoff goes with the query to every chunk. A vector that reaches it must have a partial score
   of at least cutoff / nodes somewhere, so the entries above that are sufficient; those whose known parts,
   with the threshold for the unknown ones, can't reach the cutoff are dropped.
3. The scores of the rest are resolved exactly, and the k best over all chunks are ranked.

Vectors are used as whole numbers, floor(scale * x). Ties go to the smaller id. A vector that is null
or empty, or has a null or non-finite component, and a row with a null id, takes no part. Rows that
repeat an id count once (the smallest vector). Vectors of different lengths don't meet. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowhelm.llm.storage import stored

CHUNK = 8192
BLOCK = 1024
NODES = 2
STRIP = 128


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _exact(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The matrices in the narrowest type in which their products are exact."""
    most = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * q.shape[1]
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    return q.astype(kind), v.astype(kind)


def _parts(dims: int) -> list[slice]:
    cuts = np.linspace(0, dims, min(NODES, dims) + 1).astype(int)
    return [slice(a, b) for a, b in zip(cuts, cuts[1:])]


def _strips(table: pa.Table, k: int):
    """(ids of some queries, ids of all vectors, partial scores by node, cutoffs)."""
    asks = np.asarray(table["asks"].to_numpy())
    ids, cutoffs = table["vec_id"].to_numpy(), table["cutoff"].to_numpy()
    if not asks.any() or asks.all():
        return
    matrix = _matrix(table["v"])
    queries, vectors = _exact(matrix[asks], matrix[~asks])
    own, by = ids[asks], np.argsort(ids[~asks], kind="stable")
    vectors, others = vectors[by], ids[~asks][by]
    parts = _parts(matrix.shape[1])
    for first in range(0, len(own), STRIP):
        strip = slice(first, first + STRIP)
        scores = [(queries[strip, p] @ vectors[:, p].T) for p in parts]
        scores = [s.astype(np.float64) if s.dtype == np.float32 else s for s in scores]
        yield own[strip], others, scores, cutoffs[asks][strip], own[strip, None] == others[None, :]


def _gather(k: int) -> callable:
    def run(table: pa.Table) -> pa.Table:
        ids, totals = [], []
        for own, others, parts, _, same in _strips(table, k):
            total = sum(parts)
            n = min(k, len(others))
            seen = np.zeros(total.shape, bool)
            for part in parts:
                near = np.argpartition(np.where(same, -np.inf, part), len(others) - n, axis=1)[:, len(others) - n :]
                np.put_along_axis(seen, near, True, axis=1)
            seen &= ~same
            for r in range(len(own)):
                best = np.sort(total[r, seen[r]])[::-1][:k]
                ids.append(np.full(len(best), own[r]))
                totals.append(best)
        return pa.table({"query_id": pa.array(np.concatenate(ids) if ids else [], pa.int64()), "score": pa.array(np.concatenate(totals).astype(np.int64) if totals else [], pa.int64())})

    return run


def _resolve(k: int) -> callable:
    def run(table: pa.Table) -> pa.Table:
        out = [[], [], []]
        for own, others, parts, cutoffs, same in _strips(table, k):
            cutoff = cutoffs[:, None]
            limit = cutoff / len(parts)
            high = [part >= limit for part in parts]
            bound = sum(np.where(h, part, limit) for h, part in zip(high, parts))
            keep = np.logical_or.reduce(high) & (bound >= cutoff) & ~same
            row, at = np.nonzero(keep)
            score = sum(part[row, at] for part in parts)  # the rest, exactly
            fits = score >= cutoffs[row]
            row, at, score = row[fits], at[fits], score[fits]
            by = np.lexsort((at, -score, row))  # vectors are in the order of their ids
            row, at, score = row[by], at[by], score[by]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            top = place < k
            for held, values in zip(out, (own[row[top]], others[at[top]], score[top].astype(np.int64))):
                held.append(values)
        return pa.table({n: pa.array(np.concatenate(x) if x else [], pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), out)})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best other vectors of each row of (vec_id, embedding) that is a query."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    valid = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    )
    rows = vectors.filter(F.col("vec_id").isNotNull()).filter(F.coalesce(valid, F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"), is_query.alias("asks"))
    rows = stored(rows.groupBy("vec_id", "asks").agg(F.min("v").alias("v")).withColumn("dims", F.size("v")), "vectors")
    counts = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    chunks, blocks = max(1, -(-counts.n // chunk)), max(1, -(-counts.q // block))
    held = rows.select(
        "dims", F.expr(f"pmod(xxhash64(vec_id), {chunks})").alias("chunk"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
        "vec_id", "v", F.lit(False).alias("asks"), F.lit(0.0).alias("cutoff"),
    )
    asked = rows.filter("asks").select(
        "dims", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"), F.expr(f"pmod(xxhash64(vec_id, 7), {blocks})").alias("block"),
        "vec_id", "v", "asks",
    )
    grid = ["dims", "chunk", "block"]
    first = asked.withColumn("cutoff", F.lit(0.0)).union(held).groupBy(*grid).applyInArrow(_gather(k), "query_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"))
    lower = first.withColumn("place", F.row_number().over(order)).filter(F.col("place") == k)
    cutoffs = stored(lower.select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("cutoff")), "cutoffs")
    lowest = F.coalesce("cutoff", F.lit(float("-inf")))  # fewer than k others: all of them
    again = asked.join(cutoffs, "vec_id", "left").select(*grid, "vec_id", "v", "asks", lowest.alias("cutoff"))
    found = again.union(held).groupBy(*grid).applyInArrow(_resolve(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
