"""N-gram Jaccard join by T-occurrence search (DivideSkip) in blocks.

A document's set is its distinct five-word shingles, lower-cased (A to Z); with fewer words the whole
sequence is its one shingle. Documents with no word have an empty set and no links. Two documents
link when 100 * intersection >= 80 * union. Equal sets are one class.

1. Shingles are counted exactly, in shards (see ``postings``). A set of n shingles needs at least
   0.8 n in common with any partner, so of its n - ceil(0.8 n) + 1 first shingles, in an order that all
   documents share, a partner must have one among its own first. The order is: seen once, then ever
   more often, unknown; then the hash. Shingles that occur once have no partner, so most documents drop
   out with their counts.
2. Classes that share such a first shingle are in one block (connected components of a star per list,
   so no pairs). Links never leave a block. Only the members' whole sets are made (again) and sent.
3. In a block, inverted lists of all shingles are searched: the shorter lists are merged by a heap that
   skips documents with too few occurrences, the longest are probed by binary search for those that
   are left, and a document that reaches the required overlap is linked. Documents that are in one
   component already need not be compared with each other, so a group of copies costs one search. Small
   blocks share a task; a large block is cut into chunks of bounded size, and its queries (some hubs, taken
   by hash, then all documents outside its largest component) are searched in each.

Nulls and empties: null text is empty. A row with a null id is a document with no id; it can link
others. Rows that share an id but not their text are separate documents. Repeated rows are one
class. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowhelm.llm import postings, sketch
from rowhelm.llm.columns import sealed
from rowhelm.llm.components import connected
from rowhelm.llm.storage import drop_stored, stored
from rowhelm.llm.words import Slice, mix, slices, span_sums

SHINGLE = 5
PERCENT = 80
CHUNK = 1 << 18
#: Tasks that a large block should have at least.
TASKS = 16
#: Weight of the list length in the choice of how many lists are long.
MU = 0.01
#: Hubs that are searched in a large block in each round, and rounds.
HUBS = 8
HUB_ROUNDS = 2
BYTES_PER_WORD = 6


def shingle_sets(part: Slice, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the ordered distinct shingles of row r are hashes[bounds[r]:bounds[r + 1]]."""
    words = part.word_hashes(lower=True)
    counts = np.diff(part.bounds)
    own = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(own)])
    row = np.repeat(np.arange(part.rows), own)
    start = part.bounds[row] + np.arange(len(row)) - bounds[row]
    end = np.minimum(start + size, part.bounds[row + 1])
    hashes = span_sums(words, start, end, 0)
    short = counts[row] < size
    if short.any():
        hashes[short] = mix(hashes[short] + counts[row][short].astype(np.uint64))
    new = np.ones(len(hashes), bool)
    for at in range(part.rows):
        hashes[bounds[at] : bounds[at + 1]].sort()
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def required(n: int, m: int, percent: int = PERCENT) -> int:
    """Smallest intersection of sets of n and m with 100 * intersection >= percent * union."""
    return (percent * (n + m) + 99 + percent) // (100 + percent)


class Index:
    """Inverted lists over the sets of a block."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT):
        self.sets, self.percent = sets, percent
        self.sizes = [len(s) for s in sets]
        hashes = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        docs = np.repeat(np.arange(len(sets)), self.sizes)
        by = np.argsort(hashes, kind="stable")
        hashes = hashes[by]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, int)
        self.keys, self.cuts, self.docs = hashes[first], np.append(first, len(hashes)), docs[by].tolist()

    def search(self, query: np.ndarray, but: int = -1) -> list[int]:
        """The documents that link with ``query``, without document ``but``."""
        n = len(query)
        if not n or not len(self.keys):
            return []
        least = -(-self.percent * n // 100)
        at = np.minimum(np.searchsorted(self.keys, query), len(self.keys) - 1)
        at = at[self.keys[at] == query]
        length = self.cuts[at + 1] - self.cuts[at]
        if but >= 0:
            at, length = at[length > 1], length[length > 1]
        if len(at) < least:
            return []
        by = np.argsort(length, kind="stable")
        at, length = at[by], length[by]
        longs = min(least - 1, int(least / (MU * np.log2(length[-1] + 1) + 1)))
        cut = len(at) - longs
        low, high = self.cuts[at].tolist(), self.cuts[at + 1].tolist()
        found, docs = [], self.docs
        for doc, seen in self._merge(low[:cut], high[:cut], least - longs):
            m = self.sizes[doc]
            if doc == but or self.percent * max(n, m) > 100 * min(n, m):
                continue
            need, left = required(n, m, self.percent), longs
            for k in range(cut, len(at)):  # the shortest first: they rule out most
                if seen >= need or seen + left < need:
                    break
                place = bisect_left(docs, doc, low[k], high[k])
                if place < high[k] and docs[place] == doc:
                    seen += 1
                left -= 1
            if seen >= need:
                found.append(doc)
        return found

    def _merge(self, low: list[int], high: list[int], least: int) -> Iterator[tuple[int, int]]:
        """(document, occurrences) of those in at least ``least`` of the lists, by a skipping heap."""
        docs = self.docs
        heap = [(docs[a], k) for k, a in enumerate(low)]
        heapq.heapify(heap)
        place = low[:]
        while len(heap) >= least:
            doc, popped = heap[0][0], []
            while heap and heap[0][0] == doc:
                popped.append(heapq.heappop(heap)[1])
            if len(popped) >= least:
                yield doc, len(popped)
                skip = doc + 1
            else:
                # any document before the next top has too few lists left
                while heap and len(popped) < least - 1:
                    popped.append(heapq.heappop(heap)[1])
                if not heap:
                    return
                skip = max(heap[0][0], doc + 1)
            for k in popped:
                a = place[k]
                a = a + 1 if docs[a] < skip and (a + 1 == high[k] or docs[a + 1] >= skip) else bisect_left(docs, skip, a, high[k])
                if a < high[k]:
                    place[k] = a
                    heapq.heappush(heap, (docs[a], k))


def find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def block_roots(index: Index, blocks: list) -> list[int]:
    """Root (a position) of each document: whole blocks, searched until no link can be missing."""
    parent = list(range(len(blocks)))
    members: dict = {}
    for at, block in enumerate(blocks):
        members.setdefault(block, []).append(at)
    for own in members.values():
        searched, linked = set(), set()

        def search(at):
            searched.add(at)
            for other in index.search(index.sets[at], at):
                linked.update((at, other))
                a, b = find(parent, at), find(parent, other)
                parent[max(a, b)] = min(a, b)

        for at in own:
            if at not in linked:
                search(at)
        groups: dict[int, list[int]] = {}
        for at in own:
            groups.setdefault(find(parent, at), []).append(at)
        largest = max(groups.values(), key=len)
        for group in groups.values():
            if group is not largest:
                for at in group:
                    if at not in searched:
                        search(at)
    return [find(parent, x) for x in range(len(parent))]


def _key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _counted(size: int, percent: int, shards: int) -> callable:
    """Two kinds of rows: the documents, and the posting lists of their first shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 20
        made, group = 0, postings.Group(task, shards)

        def lists(kind):
            names, blobs = group.lists()
            none = [pa.nulls(len(names), t) for t in (kind, pa.int64(), pa.int64(), pa.binary(), pa.int64())]
            return pa.RecordBatch.from_arrays([*none, pa.array([group.number] * len(names), pa.int64()), pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], COUNTED_NAMES)

        for batch in batches:
            kind = batch.column(0).type
            for part in slices(batch.column(1)):
                hashes, bounds = shingle_sets(part, size)
                n = np.diff(bounds)
                keys = [_key(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                numbers = group.add(hashes, bounds, keys, n - -(-percent * n // 100) + 1)
                own = [c.slice(part.first, part.rows) for c in (batch.column(0), batch.column(2))]
                none = [pa.nulls(part.rows, t) for t in (pa.int64(), pa.int32(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(numbers, pa.int64()), *none], COUNTED_NAMES)
                if group.full():
                    yield lists(kind)
                    made += 1
                    group = postings.Group(task + made, shards)
        if group.sets:
            yield lists(kind)

    return run


COUNTED_NAMES = ["doc_id", "text_key", "n", "class", "row", "g", "shard", "blob"]


def _sets(size: int, wanted) -> callable:
    """(key, text_key, set) of the documents whose key may be among the ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            may_be = np.flatnonzero(sketch.estimate(wanted.value, mix(keys.view(np.uint64))) > 0)
            may_be = [at for at, key in zip(may_be.tolist(), zip(keys[may_be].tolist(), batch.column(1).take(pa.array(may_be)).to_pylist())) if not (key in seen or seen.add(key))]
            if may_be:
                batch = batch.take(pa.array(may_be))
                sets = []
                for part in slices(batch.column(2)):
                    hashes, bounds = shingle_sets(part, size)
                    sets += [hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], ["key", "text_key", "set"])

    return run


def member_sets(texts: DataFrame, members: DataFrame, count: int, size: int) -> DataFrame:
    """``count`` members (key, text_key and others) with the sets of their texts, which are made from ``texts`` (key, text_key, text)."""

    def keys(batch):
        yield mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))

    cells = sketch.cells_for(count, 16)
    wanted = texts.sparkSession.sparkContext.broadcast(sketch.build(members.select("key"), keys, cells)[0])
    sets = texts.select("key", "text_key", "text").mapInArrow(_sets(size, wanted), "key long, text_key long, set binary")
    full = stored(members.join(sets, ["key", "text_key"]).drop("key", "text_key"), "full")
    wanted.destroy()
    return full


def _load(rows: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in rows["set"]]


def _whole_blocks(percent: int) -> callable:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("node").sort_values("node")
        nodes = rows["node"].to_numpy()
        roots = block_roots(Index(_load(rows), percent), rows["block"].tolist())
        return pd.DataFrame({"a": nodes, "b": nodes[roots]})

    return run


def _search_chunk(percent: int) -> callable:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["node", "asks"])
        asked = rows[rows["asks"]]
        held = rows[~rows["asks"]]
        index, nodes = Index(_load(held), percent), held["node"].to_numpy()
        place = {node: k for k, node in enumerate(nodes.tolist())}
        pairs = [(node, nodes[k]) for node, own in zip(asked["node"].tolist(), _load(asked)) for k in index.search(own, place.get(node, -1))]
        if not pairs:
            return pd.DataFrame(columns=["a", "b"], dtype="int64")
        # a link for each node will do, since only components are asked for
        names, at = np.unique(np.array(pairs, np.int64), return_inverse=True)
        at = at.reshape(-1, 2)
        root = names[postings.least_reached(len(names), at[:, 0], at[:, 1])]
        return pd.DataFrame({"a": names, "b": root})[names != root]

    return run


def _ask(queries: DataFrame, chunks: DataFrame, percent: int, known: DataFrame | None) -> DataFrame:
    """The ``known`` links, if any, and those of ``queries`` (node, block, parts, n, set) with all of their blocks, chunk by chunk."""
    asked = queries = stored(queries, "asked")
    # each part of the queries costs a copy of the block's chunks: more than the memory asks for only to have some tasks
    n = F.sum("n")
    fair = F.least(F.ceil(n / (CHUNK // 8)), F.ceil(F.lit(TASKS) / F.max("parts")))
    # a row for each large block; were the rows dealt by block for this join, they would stay so for the search
    per_block = F.broadcast(asked.groupBy("block").agg(F.greatest(F.ceil(n / CHUNK), fair).cast("int").alias("asks_in")))
    asked = (
        asked.join(per_block, "block")
        .withColumn("part", F.expr("pmod(xxhash64(node, 5), asks_in)").cast("int"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    )
    held = chunks.join(per_block, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("asks_in") - 1)))
    names = ["block", "chunk", "part", "node", "set"]
    both = asked.select(*names, F.lit(True).alias("asks")).union(held.select(*names, F.lit(False).alias("asks")))
    found = both.groupBy("block", "chunk", "part").applyInPandas(_search_chunk(percent), "a long, b long")
    links = stored(found if known is None else known.union(found), "answers")
    drop_stored(queries)
    return links


def link_classes(documents: DataFrame, blocks: DataFrame, texts: DataFrame, size: int = SHINGLE, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """(node, root) of the classes of ``documents`` (key, text_key, n, class, row) that are linked to others of their block (row, root)."""
    # equal sets are in one block; a block of one class needs no search
    members = documents.join(blocks, "row").groupBy("class").agg(F.min(F.struct("row", "key", "text_key", "n", "root")).alias("one"))
    members = members.select(F.col("one.row").alias("node"), "one.key", "one.text_key", "one.n", F.col("one.root").alias("block"))
    sized = members.groupBy("block").agg(F.sum("n").alias("total"), F.count("*").alias("classes")).filter("classes > 1")
    placed = members.join(sized.select("block", F.ceil(F.col("total") / chunk).cast("int").alias("parts")), "block")
    placed = stored(placed, "placed")
    count, total, large = placed.agg(F.count("*"), F.sum(F.when(F.col("parts") == 1, F.col("n"))), F.max(F.col("parts") > 1)).first()
    full = member_sets(texts, placed, count, size)
    drop_stored(placed)
    total = total or 0
    bins = max(1, -(-int(total) // chunk))
    whole = (
        full.filter("parts = 1")
        .withColumn("bin", F.expr(f"pmod(xxhash64(block), {bins})"))
        .groupBy("bin")
        .applyInPandas(_whole_blocks(percent), "a long, b long")
    )
    found = whole
    if large:
        chunks = full.filter("parts > 1").withColumn("chunk", F.expr("pmod(xxhash64(node, 3), parts)").cast("int"))
        links = None
        for turn in range(HUB_ROUNDS):
            free = chunks
            if links is not None:
                met = links.select("a").union(links.select("b")).distinct()
                free = chunks.join(met, chunks.node == met.a, "left_anti")
            free = free.select("block", "node", F.xxhash64("node", F.lit(turn)).alias("h"))
            free = free.groupBy("block", F.pmod("h", F.lit(HUBS)).alias("hub")).agg(F.min_by("node", "h").alias("node"))
            hubs = chunks.join(free, ["block", "node"], "left_semi").select("node", "block", "parts", "n", "set")
            links = _ask(hubs, chunks, percent, links)
        linked = connected(links, alone=False)
        groups = chunks.select("node", "block").join(linked, "node", "left").select("node", "block", F.coalesce("root", "node").alias("root"))
        counts = groups.groupBy("block", "root").agg(F.count("*").alias("c"))
        top = counts.groupBy("block").agg(F.max(F.struct("c", "root")).alias("top")).select("block", F.col("top.root").alias("root"))
        rest = groups.join(top, ["block", "root"], "left_anti").select("node")
        known = linked.select(F.col("node").alias("a"), F.col("root").alias("b"))
        links = _ask(chunks.join(rest, "node", "left_semi").select("node", "block", "parts", "n", "set"), chunks, percent, known)
        found = found.union(connected(links, alone=False).select(F.col("node").alias("a"), F.col("root").alias("b")))
    found = stored(found.select(F.col("a").alias("node"), F.col("b").alias("root")), "roots")
    drop_stored(full)
    return found


def components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), n_shingles, component (a name) and component_id of every row.

    Runs its jobs when called.
    """
    text_key = F.xxhash64("text")
    texts = docs.select("doc_id", "text", text_key.alias("text_key"), F.xxhash64("doc_id", text_key).alias("key"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = texts.select("doc_id", "text", "text_key").mapInArrow(
        _counted(size, percent, postings.shards_for(total // BYTES_PER_WORD)),
        f"doc_id {kind}, text_key long, n long, class binary, row long, g long, shard int, blob binary",
    )
    counted = stored(counted, "counted")
    sets = stored(counted.filter("row is not null").select("doc_id", "text_key", "n", "class", "row"), "sets")
    stars = postings.stars(counted.filter("g is not null").select("g", "shard", "blob"))
    drop_stored(counted)
    blocks = connected(stars, alone=False).withColumnRenamed("node", "row")
    drop_stored(stars)
    roots = link_classes(sets.withColumn("key", F.xxhash64("doc_id", "text_key")), blocks, texts, size, percent, chunk)
    # classes, then the components' smallest ids
    classes = sets.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"), F.min("row").alias("node"))
    classes = stored(classes.join(roots, "node", "left").select("class", "least", "root"), "classes")
    joined = classes.filter("root is not null").groupBy("root").agg(F.min("least").alias("smallest"))
    name = F.coalesce(F.col("root").cast("string"), F.hex("class"))
    named = classes.join(joined, "root", "left").select("class", name.alias("component"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("smallest")).alias("component_id"))
    filled = F.col("n") > 0
    return sets.select("doc_id", "text_key", "n", "class", "row").join(named, "class", "left").select(
        "doc_id",
        "text_key",
        F.col("n").alias("n_shingles"),
        F.when(filled, F.col("component")).otherwise(F.concat(F.lit("empty "), F.col("row"))).alias("component"),
        F.when(filled, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def jaccard_components(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    return components(docs, **options).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents, with their columns, less all but the one with the smallest id of each component.

    Ids that are null come last; of rows that repeat id and text the one with the smallest JSON text of all its
    columns stays; documents without words stay.
    """
    carried, opened = sealed(docs, "doc_id", "text")
    found = stored(components(carried, **options), "components")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    chosen = found.groupBy("component").agg(F.min(order).alias("first"), F.count("*").alias("rows"), F.max("n_shingles").alias("n"))
    chosen = stored(chosen.select(F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_chosen"), "n").distinct(), "chosen")
    repeated = found.filter("n_shingles > 0").groupBy("doc_id", "text_key").count().filter("count > 1").limit(1).count()
    keyed = carried.withColumn("_key", F.xxhash64("text"))
    kept = keyed.join(chosen, keyed["doc_id"].eqNullSafe(F.col("_id")) & (keyed["_key"] == F.col("_chosen")), "left_semi")
    if repeated:
        words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        row = F.struct(*carried.columns)
        first = kept.filter(words).groupBy("doc_id", "_key").agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
        kept = first.union(kept.filter(~words).drop("_key"))
    return opened(kept)
