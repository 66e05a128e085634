"""Spelling variants: words that differ by one code point, found in a trie of frequency vectors.

Words are maximal runs of ``A`` to ``Z``, ``a`` to ``z`` and U+00C0 to U+00FF, with only A to Z lower-cased. Letters
fall into ``GROUPS`` groups; the numbers of letters of a word in each group, one after the other, are its
path in the trie. Inserting, deleting or replacing one letter adds at most one to one group (surplus) and takes
at most one from another (deficit).

1. Words are counted within tasks and then grouped. The vocabulary is stored.
2. The first ``depth`` levels of the trie are dealt over tasks: a word lies in the subtree of its own first
   counts, and is asked for in every subtree that a surplus and a deficit of one can reach. ``depth`` is the
   smallest at which every subtree has at most ``limit`` words; a subtree that is still larger at the last
   depth is cut into blocks of words, and too many questions into parts, each pair of which meets once.
3. A task sorts the vectors of its subtree, which is the trie, and walks it depth first with all questions
   that are alive at a node; each carries the surplus and the deficit it has left. Subtrees of few vectors are
   compared directly. Words at the leaves reached are verified letter by letter, many pairs at a time.
4. Each word's near words are folded to their number and the best of them; forms are followed to the last by
   doubling steps: a form occurs at least ``ratio`` times as often, so chains end.

Nulls and empties: a null or empty text has no words; rows with a null id count with an empty id. Repeated rows
count each. Of near words that occur equally often the smallest in code-point order is the form. Words may be of any
length. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowhelm.llm.storage import drop_stored, stored

GROUPS = 16
#: Frequent letters first: each of the first opens a group, and the counts of the first groups split the words best.
ORDER = "etaoinsrhldcumfpgwybvkxjqz"
MIN_LETTERS = 5
MIN_COUNT = 3
RATIO = 2
DEPTHS = range(1, 7)
LIMIT = 1 << 16
#: Roles of a word in a subtree: to be found, asking in its own subtree, asking in a later one.
HELD_HERE, FROM_HERE, FROM_AFAR = range(3)
#: Counted words that a task holds before it hands them on.
HELD = 1 << 18
#: Vectors times questions that are compared directly.
DIRECT = 1 << 12
#: Pairs of words that are verified together, and letters in them.
PAIRS = 1 << 17
LETTERS = 1 << 21
_RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
GROUP_OF = np.arange(256) % GROUPS
GROUP_OF[list(ORDER.encode())] = np.arange(len(ORDER)) % GROUPS


def _counted(every: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush():
            words = [w.decode() for w in held]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc_id, raw in zip(ids, batch.column(1)):
                raw = raw.as_py()
                if not raw:
                    continue
                start = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
                for word, n in Counter(_RUN.findall(raw.lower())).items():
                    if every:
                        h = zlib.crc32(word, start)
                        if h % every == 0:
                            text = word.decode()
                            at = h % len(text)
                            word = (text[:at] + text[at + 1 :]).encode()
                    if len(word) >= least and len(word.decode()) >= least:
                        held[word] += n
                if len(held) >= HELD:
                    yield flush()
        if held:
            yield flush()

    return run


def word_counts(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, typo_every: int = 0) -> DataFrame:
    """(word, n) over all texts, of words with at least ``min_letters`` letters and ``min_count`` occurrences.

    With ``typo_every`` (a query's test feature), words whose crc32 with the document's id it divides lose one letter.
    """
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    parts = rows.mapInArrow(_counted(typo_every, min_letters), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


class Words:
    """Words of one byte a letter, end to end."""

    def __init__(self, words: list[str]):
        raw = [w.encode("latin-1") for w in words]
        self.lengths = np.array([len(w) for w in raw], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(raw), np.uint8)

    def vectors(self) -> np.ndarray:
        """Numbers of letters by group, a row for each word."""
        at = np.repeat(np.arange(len(self.lengths)), self.lengths) * GROUPS + GROUP_OF[self.letters]
        return np.bincount(at, minlength=len(self.lengths) * GROUPS).reshape(-1, GROUPS).astype(np.int32)

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of words differ by exactly one inserted, deleted or replaced letter."""
        out = np.zeros(len(a), bool)
        a, b = np.where(self.lengths[a] <= self.lengths[b], (a, b), (b, a))
        short, more = self.lengths[a], self.lengths[b] - self.lengths[a]
        order = np.lexsort((more, short))
        order = order[more[order] <= 1]
        new = np.flatnonzero(np.diff(short[order] * 2 + more[order])) + 1
        for same in np.split(order, new):
            if not len(same):
                continue
            n, one = int(short[same[0]]), int(more[same[0]])
            step = max(1, LETTERS // max(1, n))
            for at in (same[k : k + step] for k in range(0, len(same), step)):
                span = np.arange(n)
                x = self.letters[self.starts[a[at], None] + span]
                y = self.starts[b[at], None] + span
                front = x == self.letters[y]
                if not one:
                    out[at] = front.sum(axis=1) == n - 1
                    continue
                back = x == self.letters[y + 1]
                lead = np.logical_and.accumulate(front, axis=1).sum(axis=1)
                tail = np.logical_and.accumulate(back[:, ::-1], axis=1).sum(axis=1)
                out[at] = lead + tail >= n
        return out


class Trie:
    """Distinct frequency vectors in order; a node is a range of them that agree in their first counts."""

    def __init__(self, vectors: np.ndarray):
        self.order = np.lexsort(vectors.T[::-1])
        ordered = vectors[self.order]
        new = np.ones(len(ordered), bool)
        new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
        self.starts = np.append(np.flatnonzero(new), len(ordered))
        self.vectors = ordered[new]

    def leaves(self, asked: np.ndarray, surplus: int = 1, deficit: int = 1) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of ``asked``) for each leaf with at most ``surplus`` letters more and ``deficit`` fewer than the row."""
        width = self.vectors.shape[1]
        rows = np.arange(len(asked))
        todo = [(0, 0, len(self.vectors), rows, np.full(len(rows), surplus), np.full(len(rows), deficit))]
        while todo:
            level, low, high, rows, more, fewer = todo.pop()
            if not len(rows) or low == high:
                continue
            if level == width:
                yield low, rows
                continue
            if (high - low) * len(rows) <= DIRECT or high - low == 1:
                apart = self.vectors[low:high, None, level:] - asked[None, rows, level:]
                up = np.maximum(apart, 0).sum(axis=2)
                fits = (up <= more) & (up - apart.sum(axis=2) <= fewer)
                for leaf in np.flatnonzero(fits.any(axis=1)):
                    yield low + int(leaf), rows[fits[leaf]]
                continue
            column = self.vectors[low:high, level]
            cuts = low + np.concatenate([[0], np.flatnonzero(np.diff(column)) + 1, [high - low]])
            own = asked[rows, level]
            for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
                apart = self.vectors[a, level] - own
                fits = (apart <= more) & (-apart <= fewer)
                if fits.any():
                    apart = apart[fits]
                    todo.append((level + 1, a, b, rows[fits], more[fits] - np.maximum(apart, 0), fewer[fits] - np.maximum(-apart, 0)))


def _pairs(trie: Trie, has: np.ndarray, wants: np.ndarray, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(questions, words) whose frequency vectors are near, in pieces of about ``PAIRS``."""
    asked, held, n = [], [], 0
    for leaf, rows in trie.leaves(vectors[wants]):
        own = has[trie.order[trie.starts[leaf] : trie.starts[leaf + 1]]]
        step = max(1, PAIRS // len(own))
        for k in range(0, len(rows), step):
            some = wants[rows[k : k + step]]
            asked.append(np.repeat(some, len(own)))
            held.append(np.tile(own, len(some)))
            n += len(asked[-1])
            if n >= PAIRS:
                yield np.concatenate(asked), np.concatenate(held)
                asked, held, n = [], [], 0
    if n:
        yield np.concatenate(asked), np.concatenate(held)


def _search(table: pa.Table) -> pa.Table:
    """Near words that meet in one subtree: for each word their number and the best of them."""
    role = table["role"].to_numpy()
    text = table["word"].to_pylist()
    n = table["n"].to_numpy()
    has, wants = np.flatnonzero(role == HELD_HERE), np.flatnonzero(role != HELD_HERE)
    words, found = Words(text), [np.zeros((0, 2), np.int64)]
    vectors = words.vectors()
    for a, b in _pairs(Trie(vectors[has]), has, wants, vectors) if len(has) and len(wants) else ():
        near = words.near(a, b)
        a, b = a[near], b[near]
        found.append(np.stack([a, b], axis=1))
        both = role[a] == FROM_AFAR  # such a pair meets nowhere else
        found.append(np.stack([b[both], a[both]], axis=1))
    own, other = np.concatenate(found).T
    rank = np.empty(len(text), np.int64)  # by most occurrences, then the word
    rank[sorted(range(len(text)), key=lambda k: (-n[k], text[k]))] = np.arange(len(text))
    by = np.lexsort((rank[other], own))
    own, other = own[by], other[by]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    return pa.table(
        {
            "word": pa.array([text[k] for k in own[first]], pa.string()),
            "n_near": pa.array(np.diff(np.append(first, len(own))), pa.int64()),
            "best_n": pa.array(n[other[first]], pa.int64()),
            "best": pa.array([text[k] for k in other[first]], pa.string()),
        }
    )


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vocabulary with each word's frequency vector as an array."""
    for batch in batches:
        vectors = Words(batch.column(0).to_pylist()).vectors()
        offsets = np.arange(len(vectors) + 1, dtype=np.int32) * GROUPS
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors.ravel(), pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["word", "n", "vector"])


def _steps(depth: int) -> list[tuple[int, ...]]:
    """Changes of ``depth`` counts with at most one surplus and one deficit, of each and its opposite the one to the later path."""
    unit = lambda k: [int(j == k) for j in range(depth)]
    ups = [[0] * depth, *map(unit, range(depth))]
    return sorted({step for a in ups for b in ups if (step := tuple(x - y for x, y in zip(a, b))) >= (0,) * depth})


def near_words(vocabulary: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(word, n_near, best, best_n) of the words of (word, n) that have a near word. Words are distinct."""
    placed = stored(vocabulary.mapInArrow(_prefixes, "word string, n long, vector array<int>"), "vocabulary")
    path = lambda depth: F.concat_ws(",", F.slice("vector", 1, depth).cast("array<string>"))
    for depth in DEPTHS:
        most = placed.groupBy(path(depth)).count().agg(F.max("count")).first()[0] or 0
        if most <= limit:
            break
    steps = F.array(*(F.array(*map(F.lit, s)) for s in _steps(depth)))
    asked = placed.select("word", "n", "vector", F.explode(steps).alias("step")).select(
        "word", "n", F.zip_with(F.slice("vector", 1, depth), "step", lambda a, b: a + b).alias("reached"), F.exists("step", lambda c: c != 0).alias("afar")
    )
    asked = asked.filter(~F.exists("reached", lambda c: c < 0)).select("word", "n", F.concat_ws(",", F.col("reached").cast("array<string>")).alias("path"), "afar")
    held = placed.select("word", "n", path(depth).alias("path"))
    # a subtree above the limit: its words in blocks, its questions in parts
    words = held.groupBy("path").agg(F.count("*").alias("words"))
    parts = asked.groupBy("path").agg(F.count("*").alias("questions"))
    sizes = stored(
        words.join(parts, "path").select(
            "path", F.ceil(F.col("words") / limit).cast("int").alias("blocks"), F.ceil(F.col("questions") / (4 * limit)).cast("int").alias("parts")
        ),
        "subtrees",
    )
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n, seed: F.pmod(F.xxhash64("word", F.lit(seed)), F.col(n)).cast("int")
    role = F.when(F.col("afar"), FROM_AFAR).otherwise(FROM_HERE)
    stay = held.join(sizes, "path").select("path", own("blocks", 1).alias("block"), spread("parts").alias("part"), "word", "n", F.lit(HELD_HERE).alias("role"))
    come = asked.join(sizes, "path").select("path", spread("blocks").alias("block"), own("parts", 2).alias("part"), "word", "n", role.alias("role"))
    found = stay.union(come).groupBy("path", "block", "part").applyInArrow(_search, "word string, n_near long, best_n long, best string")
    rank = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), rank.alias("top")).select(
        "word", "n_near", F.col("top.best").alias("best"), (-F.col("top.less")).alias("best_n")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) with ``root`` added: the last word that forms lead to, the word itself without one.

    Steps double: after round r each word knows the word 2**r forms ahead or the last one.
    """
    at = stored(forms.select("word", F.coalesce("form", "word").alias("to")), "forms", free=False)
    while True:
        ahead = at.filter("word != to").select(F.col("word").alias("to"), F.col("to").alias("next"))
        moved = stored(at.join(ahead, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "forms", free=False)
        drop_stored(at)
        more = moved.filter("moved").limit(1).count()
        at = moved.select("word", "to")
        if not more:
            return at.withColumnRenamed("to", "root")


def spelling_variants(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, ratio: float = RATIO, typo_every: int = 0, limit: int = LIMIT) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of the documents."""
    vocabulary = stored(word_counts(docs, min_letters, min_count, typo_every), "words")
    near = near_words(vocabulary, limit)
    usual = F.col("best_n") >= ratio * F.col("n")
    known = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(usual, F.col("best")).alias("form"), F.when(usual, F.col("best_n")).alias("form_n")
    )
    known = stored(known, "variants")
    return known.join(roots(known), "word").select("word", "form", "root", "n", "n_near", "form_n")


def brute_force(rows: list[tuple], min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, ratio: float = RATIO, typo_every: int = 97) -> dict:
    """The same by all pairs of words, for tests: {word: (form, root, n, n_near, form_n)}."""
    counts: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if typo_every and h % typo_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= min_letters and n >= min_count}

    def is_near(a: str, b: str) -> bool:
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {w: [v for v in counts if is_near(v, w)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts.get(form[w]))
    return out
