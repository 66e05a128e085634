"""Near-duplicates by MinHash with tensored tables, confirmed on whole shingle sets.

A document's set is its distinct four-word shingles, lower-cased (A to Z); with fewer words the whole sequence is
its one shingle. Documents without words have an empty set and no links. Two documents link when
100 * intersection >= 80 * union.

1. Each document gets ``2 * HALVES`` half keys of ``ROWS`` minhashes each, ``HALVES`` of a first and as many of a
   second kind. A table's key is a pair of one half key of each kind, so ``HALVES**2`` tables of ``2 * ROWS``
   minhashes need no more than ``2 * HALVES * ROWS`` minhashes: about the square root. At the least similarity of
   0.8 a pair misses all tables with a chance of 2 in 100,000 (``miss``), and far less above. Equal sets
   are one class, of which one document goes on.
2. A first round takes ``HALVES`` of the tables. Each class is compared with the smallest of the bucket it shares
   most tables with; what is confirmed gives components, so that most copies come together without their pairs.
   It can be repeated with other hubs (``ROUNDS``).
3. Then all tables count, but only for classes whose half keys also occur in another component. Classes that buckets
   join are a family. Its sets are compared with those of other components in blocks of bounded size; a block
   gives one link for each set that is joined to another, not the pairs. The work grows with the square of what is
   left of a family outside its largest component, in blocks; rows only with its size.
4. All links are confirmed on full sets, made anew from the texts. A hub's partners are dealt over parts.

Nulls and empties: null text is empty. A row with a null id is a document with no id; it can link
others. Rows that share an id but not their text are separate documents. Repeated rows are one class.
An empty table gives an empty result. Extra columns are ignored. Texts are used whole, whatever their length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowhelm.llm.components import connected
from rowhelm.llm.jaccard import shingle_sets
from rowhelm.llm.storage import drop_stored, stored
from rowhelm.llm.words import mix, slices

SIZE = 4
PERCENT = 80
HALVES = 16
ROWS = 3
ROUNDS = 1
#: Partners of a hub in one part; documents, and shingles, in one chunk of a family.
PART = 512
BLOCK = 1024
WEIGHT = 1 << 19
#: Shingles of more sets than this are counted by a matrix product, so many at a time; pairs counted together.
DENSE = 32
STRIP = 2048
PAIRS = 1 << 20
#: What names a block.
AT = ["family", "i", "j"]
#: Bits of the filter that picks the texts of candidates, a fixed 16 MB at most.
BITS = 1 << 27

_rng = np.random.default_rng(19970303)
_FACTORS = _rng.integers(1, 1 << 63, size=2 * HALVES * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIXERS = _rng.integers(1, 1 << 63, size=2 * HALVES * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def miss(similarity: float) -> float:
    """Chance that a pair of this similarity shares no table."""
    return 1 - (1 - (1 - similarity**ROWS) ** HALVES) ** 2


def minhashes(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of minhashes for each of the sets ``hashes[bounds[r]:bounds[r + 1]]``, none of them empty."""
    out = np.empty((len(bounds) - 1, len(_FACTORS)), np.uint64)
    for k, factor in enumerate(_FACTORS):
        out[:, k] = np.minimum.reduceat(hashes * factor, bounds[:-1])
    return out


def half_keys(least: np.ndarray) -> np.ndarray:
    """A row of ``2 * HALVES`` keys for each row of minhashes."""
    return mix((least * _MIXERS).reshape(len(least), 2 * HALVES, ROWS).sum(axis=2))


def _signed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(2)):
                hashes, bounds = shingle_sets(part, size)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                least = minhashes(hashes, np.append(bounds[full], len(hashes)))
                keys = half_keys(least).view(np.int64)
                raw, cls, u, v = hashes.tobytes(), [None] * part.rows, [None] * part.rows, [None] * part.rows
                for at, row in enumerate(full.tolist()):
                    cls[row] = hashlib.blake2b(raw[8 * bounds[row] : 8 * bounds[row + 1]], digest_size=16).digest()
                    u[row], v[row] = keys[at, :HALVES], keys[at, HALVES:]
                lists = [pa.array(x, pa.list_(pa.int64())) for x in (u, v)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(part.first, part.rows) for c in (0, 1)), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), *lists],
                    ["doc_id", "text_key", "n", "class", "u", "v"],
                )

    return run


def _picked(bits):
    """Rows whose place (the first column) is set in the broadcast bit array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value
        for batch in batches:
            at = batch.column(0).to_numpy()
            yield batch.filter(pa.array((held[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))

    return run


def candidate_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the rows ``wanted`` (node, doc_id, text_key): texts of others are left out before the shuffle.

    The filter has a fixed size; if it is full, more texts are shuffled, and the join drops them.
    """
    context = docs.sparkSession.sparkContext
    place = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(BITS))
    maps = wanted.select(place.alias("at")).groupBy((F.col("at") / F.lit(32768)).cast("int").alias("bucket"))
    held = np.zeros(BITS // 8, np.uint8)
    for row in maps.agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits")).toLocalIterator():  # at most BITS / 8 bytes
        held[row.bucket * 4096 : (row.bucket + 1) * 4096] = np.frombuffer(row.bits, np.uint8)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(place.alias("at"), "doc_id", "text_key", "text")
    rows = rows.mapInArrow(_picked(context.broadcast(held)), f"at long, doc_id {kind}, text_key long, text string")
    same = rows["doc_id"].eqNullSafe(F.col("id")) & (rows["text_key"] == F.col("key"))
    names = wanted.select("node", F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    found = rows.join(names, same).select("node", "text")
    return stored(found.dropDuplicates(["node"]), "texts")


def _confirmed(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, np.uint64)
        for batch in batches:
            heads, a, b = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), batch.column(2)
            linked = []
            for part in slices(batch.column(3)):
                hashes, bounds = shingle_sets(part, size)
                for row in range(part.rows):
                    own = hashes[bounds[row] : bounds[row + 1]]
                    if heads[part.first + row]:
                        hub = own
                        continue
                    if percent * max(len(own), len(hub)) > 100 * min(len(own), len(hub)):
                        continue
                    at = np.minimum(np.searchsorted(hub, own), len(hub) - 1)
                    both = int((hub[at] == own).sum())
                    if 100 * both >= percent * (len(own) + len(hub) - both):
                        linked.append(part.first + row)
            at = pa.array(linked, pa.int64())
            yield pa.RecordBatch.from_arrays([a.take(at), b.take(at)], ["a", "b"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets link; a is the hub. Pairs are distinct."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    heads = many.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("b"), F.lit(True).alias("head"))
    tails = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), "b", F.lit(False).alias("head"))
    rows = heads.union(tails).join(texts.withColumnRenamed("node", "b"), "b")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.desc("head")).select("head", "a", "b", "text")
    return stored(rows.mapInArrow(_confirmed(size, percent), "a long, b long"), "links")


def labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with ``comp``, the smallest node they are linked to over ``links``."""
    return nodes.join(connected(links), "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")


def hub_pairs(nodes: DataFrame, turn: int) -> DataFrame:
    """(a, b): each node of (node, comp, u, v) with the hub it shares most of ``HALVES`` tables with, of another component."""
    table = F.arrays_zip(F.col("u").alias("u"), F.col("v").alias("v"))
    keys = nodes.select("node", "comp", F.explode(table).alias("t")).select(F.xxhash64("t.u", "t.v").alias("key"), "node", "comp")
    order = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "comp") if turn else F.struct(F.lit(0).cast("long").alias("h"), "node", "comp")
    hubs = keys.groupBy("key").agg(F.min(order).alias("hub"), F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least != most")
    met = keys.join(hubs.select("key", "hub"), "key").filter("comp != hub.comp").groupBy("node", F.col("hub.node").alias("a")).count()
    best = Window.partitionBy("node").orderBy(F.desc("count"), "a")
    return met.withColumn("at", F.row_number().over(best)).filter("at = 1").select("a", F.col("node").alias("b"))


def shared_shingles(hashes: np.ndarray, bounds: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets ``left`` with other sets ``right``, both numbers of ordered sets.

    Shingles of many sets are counted by a matrix product, the others pair by pair.
    """
    place = np.full((2, len(bounds) - 1), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    by = np.argsort(hashes, kind="stable")
    same = hashes[by]
    new = np.concatenate([[True], same[1:] != same[:-1]]) if len(same) else np.zeros(0, bool)
    number = np.cumsum(new) - 1
    often = np.bincount(number)[number] if len(number) else np.zeros(0, int)
    owner, often = owner[by], often
    both = np.zeros((len(left), len(right)), np.float32)
    dense = often > DENSE
    _, column = np.unique(number[dense], return_inverse=True)
    columns = int(column.max()) + 1 if len(column) else 0
    for first in range(0, columns, STRIP):
        strip = (column >= first) & (column < first + STRIP)
        sides = []
        for side, size in enumerate(both.shape):
            at = place[side, owner[dense][strip]]
            has = np.zeros((size, min(STRIP, columns - first)), np.float32)
            has[at[at >= 0], column[strip][at >= 0] - first] = 1
            sides.append(has)
        both += sides[0] @ sides[1].T
    few = (often > 1) & ~dense
    own, number = owner[few], number[few]
    asks = np.flatnonzero(place[0, own] >= 0)
    has = np.flatnonzero(place[1, own] >= 0)
    low, high = (np.searchsorted(number[has], number[asks], side=side) for side in ("left", "right"))
    flat = both.ravel()
    for rows in np.split(np.arange(len(asks)), np.flatnonzero(np.diff(np.cumsum(high - low) // PAIRS)) + 1):
        n = (high - low)[rows]
        b = has[np.repeat(low[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        cell = place[0, own[np.repeat(asks[rows], n)]] * len(right) + place[1, own[b]]
        cell, times = np.unique(cell, return_counts=True)
        flat[cell] += times
    return both


def _block_links(size: int, percent: int):
    """Links within a block: of each set that links with others to the first set it is connected with."""

    def compared(table: pa.Table) -> pa.RecordBatch:
        node, side = table["node"].to_numpy(), table["side"].to_numpy()
        sets = [shingle_sets(part, size) for part in slices(table["text"].combine_chunks())]
        hashes = np.concatenate([h for h, _ in sets])
        sizes = np.concatenate([np.diff(b) for _, b in sets])
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        both = shared_shingles(hashes, np.concatenate([[0], np.cumsum(sizes)]), left, right)
        linked = 100 * both >= percent * (sizes[left][:, None] + sizes[right][None, :] - both)
        label = np.arange(len(node))
        while True:
            before = label.copy()
            label[right] = np.minimum(label[right], np.where(linked, label[left][:, None], len(node)).min(axis=0, initial=len(node)))
            label[left] = np.minimum(label[left], np.where(linked, label[right][None, :], len(node)).min(axis=1, initial=len(node)))
            if (label == before).all():
                break
        moved = label != np.arange(len(node))
        return pa.RecordBatch.from_arrays([pa.array(node[label[moved]]), pa.array(node[moved])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*left, batch])
            key = np.stack([table[c].to_numpy() for c in AT], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist()]
            for a, b in zip(cuts, cuts[1:]):
                yield compared(table.slice(a, b - a))
            left = table.slice(cuts[-1]).to_batches()
        if left:
            yield compared(pa.Table.from_batches(left))

    return run


def _shared(nodes: DataFrame, half: str) -> DataFrame:
    """(node, half): the half keys of each node that also occur in another component."""
    keys = nodes.select("node", "comp", F.explode(half).alias("key"))
    many = keys.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least != most")
    return keys.join(many.select("key"), "key").groupBy("node").agg(F.collect_list("key").alias(half))


def mixed_buckets(nodes: DataFrame) -> DataFrame:
    """(key, node): the buckets of all tables that hold more than one component of (node, comp, u, v)."""
    live = _shared(nodes, "u").join(_shared(nodes, "v"), "node").join(nodes.select("node", "comp"), "node")
    keys = live.select("node", "comp", F.explode("u").alias("u"), "v").select("node", "comp", "u", F.explode("v").alias("v"))
    keys = keys.select(F.xxhash64("u", "v").alias("key"), "node", "comp")
    mixed = keys.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least != most")
    return keys.join(mixed.select("key"), "key").select("key", "node")


def family_links(nodes: DataFrame, texts: DataFrame, size: int, percent: int, block: int = BLOCK, weight: int = WEIGHT) -> DataFrame:
    """(a, b): what links the components of (node, comp, n, u, v) that share buckets, found on whole sets.

    Nodes that buckets join are a family. Small families are put together into blocks. A large one is dealt into
    chunks, those of its largest component apart, and every two chunks but two of that component are a block.
    """
    buckets = stored(mixed_buckets(nodes), "buckets")
    hubs = buckets.groupBy("key").agg(F.min("node").alias("a"))
    stars = buckets.join(hubs, "key").filter("a != node").select("a", F.col("node").alias("b")).distinct()
    members = connected(stars).withColumnRenamed("root", "family").join(nodes.select("node", "comp", "n"), "node")
    members = stored(members, "families")
    parts = members.groupBy("family", "comp").agg(F.count("*").alias("count"), F.sum("n").alias("weight"))
    sizes = parts.groupBy("family").agg(F.max(F.struct("count", "comp", "weight")).alias("top"), F.sum("count").alias("count"), F.sum("weight").alias("weight"))
    chunks = lambda count, w: F.greatest(F.lit(1), F.ceil(count / block), F.ceil(w / weight)).cast("int")
    sizes = sizes.select(
        "family", F.col("top.comp").alias("top"), ((F.col("count") <= block) & (F.col("weight") <= weight)).alias("small"),
        chunks(F.col("top.count"), F.col("top.weight")).alias("inner"), chunks(F.col("count") - F.col("top.count"), F.col("weight") - F.col("top.weight")).alias("outer"),
    )
    placed = members.join(sizes, "family")
    total = placed.filter("small").agg(F.count("*").alias("count"), F.sum("n").alias("weight")).first()
    packs = max(1, -(-total["count"] // block), -(-(total["weight"] or 0) // weight)) * 2
    small = placed.filter("small").select(
        F.lit(-1).cast("long").alias("family"), F.pmod(F.xxhash64("family"), F.lit(packs)).cast("int").alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side"), "node"
    )
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    own = F.when(F.col("comp") == F.col("top"), deal("inner")).otherwise(F.col("inner") + deal("outer"))
    others = F.sequence(F.when(F.col("own") < F.col("inner"), F.col("inner")).otherwise(0), F.col("inner") + F.col("outer") - 1)
    large = placed.filter("not small").withColumn("own", own).withColumn("other", F.explode(others)).select(
        "family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"), "node",
    )
    rows = small.union(large).join(texts, "node").repartition(*AT).sortWithinPartitions(*AT).select(*AT, "side", "node", "text")
    return stored(rows.mapInArrow(_block_links(size, percent), "a long, b long"), "links")


def near_duplicates(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row. Runs its jobs when called."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = texts.mapInArrow(_signed(size), f"doc_id {kind}, text_key long, n long, class binary, u array<long>, v array<long>")
    signed = stored(signed.withColumn("row", F.monotonically_increasing_id()), "signed")
    classes = signed.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"), F.min("row").alias("node"))
    classes = stored(classes, "classes")
    nodes = stored(signed.join(classes.select("node"), F.col("row") == F.col("node")).select("node", "doc_id", "text_key", "n", "u", "v"), "nodes")
    alone = nodes.withColumn("comp", F.col("node"))
    maybe = _shared(alone, "u").select("node").join(_shared(alone, "v").select("node"), "node")
    nodes = stored(nodes.join(maybe, "node"), "candidates")
    held = candidate_texts(texts, nodes.select("node", "doc_id", "text_key"))
    links = None
    for turn in range(ROUNDS):
        state = nodes.withColumn("comp", F.col("node")) if links is None else stored(labelled(nodes, links), "labelled")
        more = confirmed(hub_pairs(state, turn), held, size, percent)
        links = more if links is None else links.union(more)
    links = links.union(family_links(stored(labelled(nodes, links), "labelled"), held, size, percent))
    roots = connected(links).withColumnRenamed("root", "comp")
    joined = classes.join(roots, "node", "left").select("class", "least", F.coalesce("comp", "node").alias("comp"))
    smallest = joined.groupBy("comp").agg(F.min("least").alias("smallest"))
    named = stored(joined.join(smallest, "comp").select("class", "smallest"), "components")
    drop_stored(held)
    out = signed.select("doc_id", "n", "class").join(named, "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("doc_id")).alias("component_id")
    )
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
