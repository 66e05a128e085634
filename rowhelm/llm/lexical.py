"""Ranked lexical search with range-maximum tables over posting lists.

A document's score for an item is the sum, over the item's terms with repeats, of the term's impact in
the document: ``w * ((10**9 * tf) div (1000 * tf + 8 * m))``, all in 64-bit integers (see ``impacts``).

1. The items are taken in blocks of at most ``block`` different terms (one item at least), so what goes to the
   driver and to every task is bounded; a benchmark of thousands of items is one block. One pass over the texts
   counts the block's terms in every document and stores (doc_id, length, terms, counts): the postings.
2. Document frequencies, the number of documents and of terms are aggregates over the postings.
3. Tasks cut their postings into shards of ``shard`` documents, ordered by length. A shard's posting lists, one
   after the other, carry one sparse table of the places of range maxima. For an item, document intervals
   are searched best first: an interval's bound is the sum of its terms' range maxima; the interval is split
   at the document that holds the largest of these, whose score is computed, and the two parts get bounds of
   their own. Intervals below the k-th best score so far are never opened; several are split at a time.
4. A first, short search of all shards gives scores whose k-th best over all is a safe cutoff for each
   item; the second one starts from it. The k best of all shards are ranked.

Nulls and empties: a null or empty text has no terms and isn't counted in N; a document with a null id
counts in the statistics but isn't ranked; an item without terms or without a match gets no row. Equal scores go to
the smaller doc_id. Repeated documents have a rank each; repeated items have the same rows each. Empty tables give
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowhelm.llm.storage import drop_stored, stored
from rowhelm.llm.words import CODES, LOWER, Slice, slices, span_sums

K = 10
BLOCK = 1 << 16
SHARD = 1 << 13
#: Intervals of an item that are split together.
AT_ONCE = 32
#: Everything but digits, letters and what is beyond ASCII separates terms.
SEPARATORS = np.array([c < 0x80 and not chr(c).isalnum() for c in range(256)])
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_A_TO_Z = {c: c + 32 for c in range(65, 91)}


def terms_of(text: str | None) -> list[str]:
    return _TERM.findall((text or "").translate(_A_TO_Z))


def term_hashes(part: Slice) -> np.ndarray:
    return span_sums(CODES[0][LOWER[part.data]], part.starts, part.ends, 0)


def hashes_of(terms: list[str]) -> np.ndarray:
    found = [term_hashes(part) for part in slices(pa.array(terms, pa.string()), separators=SEPARATORS)]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _postings(vocabulary):
    """Counts of the terms whose ordered hashes are broadcast: their numbers are the places in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            for part in slices(batch.column(1), separators=SEPARATORS):
                hashes = term_hashes(part)
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[at] == hashes
                both = part.row_of_word()[hit] * len(known) + at[hit]
                both, counts = np.unique(both, return_counts=True)
                offsets = np.searchsorted(both, np.arange(part.rows + 1) * len(known)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x, kind)) for x, kind in ((both % len(known), pa.int32()), (counts, pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, part.rows), pa.array(np.diff(part.bounds), pa.int64()), *lists], ["doc_id", "length", "terms", "counts"]
                )

    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, length: np.ndarray, w: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 100 - 75 + (75 * length * n_docs) // n_terms
    return w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class Shard:
    """Posting lists of some documents, by term and then by document, with one sparse table over them all.

    ``table[j][p]`` is the place of the largest impact among the 2**j postings from p. Ranges are asked within
    one list, so that lists may lie end to end.
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int):
        self.docs = docs
        by = np.argsort(term * docs + doc)
        self.impact = impact[by]
        self.doc = doc[by]
        self.key = (term * docs + doc)[by]
        longest = int(np.bincount(term).max(initial=0)) if len(term) else 0
        self.table = [np.arange(len(by), dtype=np.int32)]
        while 2 << (len(self.table) - 1) <= longest:
            half = 1 << (len(self.table) - 1)
            last = self.table[-1]
            left, right = last[:-half], last[half:]
            self.table.append(np.where(self.impact[left] >= self.impact[right], left, right))
        self.starts = np.zeros(len(self.table), np.int64)
        self.starts[1:] = np.cumsum([len(t) for t in self.table])[:-1]
        self.table = np.concatenate(self.table) if len(by) else np.zeros(0, np.int32)

    def most(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, impact) of the largest impact in each range of postings; impact 0 of an empty one."""
        size = high - low
        level = np.frexp(np.maximum(size, 1))[1] - 1
        start = self.starts[level]
        some = size > 0
        left = self.table[np.where(some, start + low, 0)]
        right = self.table[np.where(some, start + high - (1 << level), 0)]
        place = np.where(self.impact[left] >= self.impact[right], left, right)
        return place, np.where(some, self.impact[place], 0)

    def search(self, terms: np.ndarray, repeats: np.ndarray, ids: np.ndarray, k: int, cutoff: int, splits: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(scores, documents) of at most ``k`` documents, the best of the shard that reach ``cutoff``.

        With ``splits``, only so many rounds are made: the scores are right, but others may be missing.
        """
        ends = np.searchsorted(self.key, [terms * self.docs, (terms + 1) * self.docs])
        there = ends[0] < ends[1]
        terms, repeats, low, high = terms[there], repeats[there], ends[0][there], ends[1][there]
        got_scores, got_docs = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(terms):
            return got_scores, got_docs
        low, high = low[None, :], high[None, :]
        place, most = self.most(low, high)
        bound = (most * repeats).sum(axis=1)
        threshold, rounds = max(cutoff, 1), 0
        while len(bound) and (splits is None or rounds < splits):
            rounds += 1
            if len(bound) > AT_ONCE:
                first = np.argpartition(-bound, AT_ONCE)
                now, later = first[:AT_ONCE], first[AT_ONCE:]
            else:
                now, later = np.arange(len(bound)), np.zeros(0, int)
            # the document of the largest range maximum, and its score
            widest = (most[now] * repeats).argmax(axis=1)
            doc = self.doc[place[now, widest]]
            cut = np.searchsorted(self.key, terms[None, :] * self.docs + doc[:, None])
            inside = cut < high[now]
            hit = inside & (self.doc[np.where(inside, cut, 0)] == doc[:, None])
            score = (np.where(hit, self.impact[np.where(inside, cut, 0)], 0) * repeats).sum(axis=1)
            got_scores, got_docs = np.concatenate([got_scores, score]), np.concatenate([got_docs, doc])
            best = np.lexsort((ids[got_docs], -got_scores))[:k]
            got_scores, got_docs = got_scores[best], got_docs[best]
            if len(best) == k:
                threshold = max(threshold, int(got_scores[-1]))
            # the parts left and right of it, beside the intervals that were not opened
            a = np.concatenate([low[later], low[now], cut + hit])
            b = np.concatenate([high[later], cut, high[now]])
            new = len(later)
            fresh_place, fresh_most = self.most(a[new:], b[new:])
            place, most = np.concatenate([place[later], fresh_place]), np.concatenate([most[later], fresh_most])
            bound = np.concatenate([bound[later], (fresh_most * repeats).sum(axis=1)])
            open_ = bound >= threshold
            low, high, place, most, bound = a[open_], b[open_], place[open_], most[open_], bound[open_]
        enough = got_scores >= max(cutoff, 1)
        return got_scores[enough], got_docs[enough]


def _searched(items, weights, cutoffs, totals: tuple[int, int], k: int, shard: int, splits: int | None):
    """Postings to (item, doc_id, score): the best of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, w, best = items.value, weights.value, dict(cutoffs.value)

        def searched(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(rows).combine_chunks()
            table = table.take(np.lexsort((table["doc_id"].to_numpy(), table["length"].to_numpy())))
            lists = table["terms"].combine_chunks()
            ids, length = table["doc_id"].to_numpy(), table["length"].to_numpy()
            doc = np.repeat(np.arange(len(table)), np.diff(lists.offsets.to_numpy()))
            term = lists.flatten().to_numpy().astype(np.int64)
            tf = table["counts"].combine_chunks().flatten().to_numpy()
            index = Shard(term, doc, impacts(tf, length[doc], w[term], *totals), len(table))
            out = [[], [], []]
            for item, terms, repeats in asked:
                scores, found = index.search(terms, repeats, ids, k, best.get(item, 1), splits)
                if splits is None and len(scores) == k:
                    best[item] = max(best.get(item, 1), int(scores[-1]))
                for held, values in zip(out, (np.full(len(found), item), ids[found], scores)):
                    held.append(values)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], ["item", "doc_id", "score"])

        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, shard):
                held.append(batch.slice(at, shard))
                n += held[-1].num_rows
                if n >= shard:
                    yield searched(held)
                    held, n = [], 0
        if n:
            yield searched(held)

    return run


def _block_search(docs: DataFrame, items: list[tuple[int, Counter]], k: int, shard: int) -> DataFrame:
    """(item, rank, doc_id, score) of a block of items, each a number and its terms."""
    context = docs.sparkSession.sparkContext
    terms = sorted({t for _, own in items for t in own})
    hashes = hashes_of(terms)
    order = np.argsort(hashes)
    number = {terms[k]: at for at, k in enumerate(order.tolist())}
    vocabulary = context.broadcast(hashes[order])
    postings = docs.mapInArrow(_postings(vocabulary), "doc_id long, length long, terms array<int>, counts array<long>")
    postings = stored(postings.filter("length > 0"), "postings")
    vocabulary.destroy()
    total = postings.agg(F.count("*").alias("n"), F.sum("length").alias("terms")).first()
    df = dict(map(tuple, postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect()))  # at most a block's terms
    w = np.array([weight(total.n, df.get(t, 0)) for t in range(len(terms))], np.int64)
    asked = [(item, np.array([number[t] for t in own], np.int64), np.array(list(own.values()), np.int64)) for item, own in items]
    shared = [context.broadcast(asked), context.broadcast(w)]
    useful = postings.filter("doc_id is not null and size(terms) > 0")
    schema = "item long, doc_id long, score long"
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    none = context.broadcast({})
    first = ranked(useful.mapInArrow(_searched(*shared, none, (total.n, total.terms), k, shard, 1), schema))
    cutoffs = context.broadcast({r.item: r.score for r in first.filter(F.col("rank") == k).collect()})  # one a item
    found = useful.mapInArrow(_searched(*shared, cutoffs, (total.n, total.terms), k, shard, None), schema)
    out = stored(ranked(found), "ranked")
    drop_stored(postings)
    for one in (*shared, none, cutoffs):
        one.destroy()
    return out


def search(docs: DataFrame, items: DataFrame, k: int = K, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best of (doc_id, text) for each row of (item_id, text).

    Runs its jobs when called.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = stored(items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()), "items", free=False)
    found, own, terms = [], [], set()
    for row in held.toLocalIterator():
        counts = Counter(terms_of(row.text))
        if own and len(terms | counts.keys()) > block:
            found.append(_block_search(docs, own, k, shard))
            own, terms = [], set()
        if counts:
            own.append((row.item, counts))
            terms |= counts.keys()
    if own:
        found.append(_block_search(docs, own, k, shard))
    if not found:
        return held.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    whole = found[0]
    for more in found[1:]:
        whole = whole.union(more)
    return whole.join(held.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def brute_force(docs: list[tuple], items: list[tuple], k: int = K) -> list[tuple]:
    """The same from all scores, for tests: ordered (item_id, rank, doc_id, score)."""
    counted = [(doc_id, Counter(terms_of(text))) for doc_id, text in docs]
    counted = [(doc_id, own) for doc_id, own in counted if own]
    n_docs, n_terms = len(counted), sum(own.total() for _, own in counted)
    df = Counter(t for _, own in counted for t in own)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, own in counted:
            m = 25 + (75 * own.total() * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * own[t]) // (1000 * own[t] + 8 * m)) for t in terms_of(text))
            if score > 0 and doc_id is not None:
                scores.append((-score, doc_id))
        out += [(item_id, r, doc_id, -score) for r, (score, doc_id) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)
