"""Language ID: script ranges, then Viterbi over word scores with a switching penalty.

The scripts of a word's letters narrow its languages to those that were seen to use them. Each word
has a log-likelihood for each language, from the trigrams of its bytes (lower-cased, with its
borders); the path through the words of a text that has the highest sum, less ``penalty`` for each
change, labels its spans. The language with the most letters in such spans is the prediction, their
share the score.

The model is learned from at most ``max_per_language`` documents of each language (those with the
smallest hash of their id). Prediction reads the text alone, whole.

Nulls and empties: null text and text without a letter is ``und`` with score 0 and no spans. Ties go
to the language first in the alphabet. Where no learned language uses a word's scripts, all stay
possible. With nothing to learn from, every text is ``und``. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowhelm.llm.words import LOWER, slices

MAX_PER_LANGUAGE = 1500
BUCKETS = 1 << 15
PENALTY = 12.0
CLIP = 9.0
UND = "und"
# Scripts and their code point ranges (Unicode blocks with letters).
SCRIPTS = [
    ("Latin", [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x1E00, 0x1EFF)]),
    ("Greek", [(0x370, 0x3FF), (0x1F00, 0x1FFF)]),
    ("Cyrillic", [(0x400, 0x52F)]),
    ("Armenian", [(0x531, 0x587)]),
    ("Hebrew", [(0x5D0, 0x5F2)]),
    ("Arabic", [(0x620, 0x64A), (0x66E, 0x6D3), (0x6FA, 0x6FF), (0x750, 0x77F)]),
    ("Devanagari", [(0x904, 0x97F)]),
    ("Thai", [(0xE01, 0xE30), (0xE32, 0xE46)]),
    ("Georgian", [(0x10A0, 0x10FF)]),
    ("Hangul", [(0x1100, 0x11FF), (0xAC00, 0xD7A3)]),
    ("Kana", [(0x3041, 0x30FF)]),
    ("Han", [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)]),
]
_EDGES = np.array([e for _, ranges in SCRIPTS for low, high in ranges for e in (low, high + 1)])
_BITS = np.array([1 << k for k, (_, ranges) in enumerate(SCRIPTS) for _ in ranges])
_ORDER = np.argsort(_EDGES[::2])
LOWS, HIGHS, BITS = _EDGES[::2][_ORDER], _EDGES[1::2][_ORDER], _BITS[_ORDER]
OTHER = 1 << len(SCRIPTS)


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the first byte, code point) of the characters beyond ASCII."""
    at = np.flatnonzero(data >= 0xC0)
    pad = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
    lead = pad[at]
    more = [pad[at + k] & 0x3F for k in (1, 2, 3)]
    two = (lead & 0x1F) << 6 | more[0]
    three = (lead & 0x0F) << 12 | more[0] << 6 | more[1]
    four = (lead & 0x07) << 18 | more[0] << 12 | more[1] << 6 | more[2]
    return at, np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four))


def letter_bits(data: np.ndarray) -> np.ndarray:
    """For each byte the script of the letter that begins there, as a bit; 0 elsewhere."""
    out = np.zeros(len(data), np.int32)
    out[((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128)] = 1
    at, points = code_points(data)
    if len(at):
        points, back = np.unique(points, return_inverse=True)
        # ranges tell the script; whether a code point is a letter is its category's to say
        letters = np.array([chr(p).isalpha() for p in points.tolist()])
        k = np.searchsorted(LOWS, points, side="right") - 1
        known = (k >= 0) & (points < HIGHS[k])
        bits = np.where(letters, np.where(known, BITS[k], OTHER), 0)[back]
        out[at] = bits
    return out


def trigrams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bucket of the trigram around each byte; other words' bytes count as a border."""
    low = LOWER[data].astype(np.uint32)
    left = np.empty_like(low)
    left[:1] = 0
    left[1:] = low[:-1]
    left[starts] = 0
    right = np.empty_like(low)
    right[-1:] = 0
    right[:-1] = low[1:]
    right[ends - 1] = 0
    return ((left * np.uint32(65599) + low) * np.uint32(65599) + right) * np.uint32(0x9E3779B1) >> np.uint32(17)


class Model:
    def __init__(self, names: list[str], counts: np.ndarray, scripts: np.ndarray):
        """counts: languages x buckets; scripts: languages x (scripts and others), letters seen."""
        self.names = names
        chance = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
        self.logs = np.log(chance).astype(np.float32)
        if len(names):
            self.logs -= self.logs.mean(axis=0)
        self.uses = scripts > 0.001 * scripts.sum(axis=1, keepdims=True)

    def parts(self) -> tuple:
        """What goes into a broadcast: plain values, which executors can read without this package."""
        return self.names, self.logs, self.uses

    @classmethod
    def of(cls, names: list[str], logs: np.ndarray, uses: np.ndarray) -> Model:
        model = cls.__new__(cls)
        model.names, model.logs, model.uses = names, logs, uses
        return model

    def word_scores(self, part) -> tuple[np.ndarray, np.ndarray]:
        """(words x languages scores, letters of each word)."""
        n, data = len(part.starts), part.data
        scores = np.zeros((n, len(self.names)), np.float32)
        bits = letter_bits(data)
        letters = np.concatenate([[0], np.cumsum(bits > 0)])
        letters = letters[part.ends] - letters[part.starts]
        if n:
            own = trigrams(data, part.starts, part.ends)
            # sums over a word as differences, in doubles: spans between words don't count
            for k in range(len(self.names)):
                sums = np.concatenate([[0.0], np.cumsum(self.logs[k][own], dtype=np.float64)])
                scores[:, k] = sums[part.ends] - sums[part.starts]
            scores = np.clip(scores - scores.max(axis=1, keepdims=True), -CLIP, 0)
            scripts = np.bitwise_or.reduceat(np.append(bits, 0), np.stack([part.starts, part.ends], 1).ravel())[::2]
            for value in np.unique(scripts):
                if value:
                    wanted = [k for k in range(self.uses.shape[1]) if value >> k & 1]
                    fits = self.uses[:, wanted].all(axis=1)
                    if fits.any() and not fits.all():
                        scores[np.ix_(scripts == value, ~fits)] = -2 * CLIP
            scores[letters == 0] = 0
        return scores, letters

    def paths(self, scores: np.ndarray, bounds: np.ndarray, penalty: float) -> np.ndarray:
        """Best language of each word: all texts go forward together, longest first."""
        length = np.diff(bounds)
        order = np.argsort(-length, kind="stable")
        first, length = bounds[:-1][order], length[order]
        kind = np.min_scalar_type(max(1, scores.shape[1]))
        path = np.zeros(len(scores), kind)
        if not len(length) or length[0] == 0:
            return path
        stays = np.zeros(scores.shape, bool)
        best_from = np.zeros(len(scores), kind)
        active = np.searchsorted(-length, -np.arange(length[0]), side="left")
        value = scores[first[: active[0]]].astype(np.float64)
        for t in range(1, length[0]):
            n = active[t]
            at = first[:n] + t
            own = value[:n]
            lead = own.argmax(axis=1)
            jump = own[np.arange(n), lead][:, None] - penalty
            stays[at] = own >= jump
            best_from[at] = lead
            own = np.maximum(own, jump) + scores[at]
            value[:n] = own - own.max(axis=1, keepdims=True)
        state = value.argmax(axis=1).astype(kind)  # each text's value is the one at its last word
        for t in range(length[0] - 1, -1, -1):
            n = active[t]
            at = first[:n] + t
            path[at] = state[:n]
            if t:
                state[:n] = np.where(stays[at, state[:n]], state[:n], best_from[at])
        return path


def _labelled(column: pa.Array, model: Model, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(path, letters, bounds) of all words of a batch of texts."""
    scores, letters, bounds, n = [], [], [np.zeros(1, np.int64)], 0
    for part in slices(column):
        own, count = model.word_scores(part)
        scores.append(own)
        letters.append(count)
        bounds.append(part.bounds[1:] + n)
        n += len(own)
    bounds = np.concatenate(bounds)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), bounds
    return model.paths(np.concatenate(scores), bounds, penalty), np.concatenate(letters), bounds


def learn(docs: DataFrame, learnable: Column, max_per_language: int = MAX_PER_LANGUAGE) -> Model:
    """From at most ``max_per_language`` documents of each ``lang`` among the ``learnable`` rows."""
    known = docs.filter(learnable & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    # which hashes are small is settled on ids alone; a hash's share of each language bounds the sort
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), F.lit(4.0 * max_per_language) / F.col("n"))
    near = known.join(F.broadcast(counts), "lang").filter(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < share * (1 << 30))
    order = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)), "doc_id", F.xxhash64("text"))
    sample = near.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= max_per_language).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for part in slices(batch.column(1)):
                grams = trigrams(part.data, part.starts, part.ends)
                row = part.row_of_word()
                spread = np.repeat(row, part.ends - part.starts)
                keep = np.zeros(len(part.data) + 1, np.int64)
                np.add.at(keep, part.starts, 1)
                np.subtract.at(keep, part.ends, 1)
                inside = np.cumsum(keep[:-1]) > 0
                bits, grams = letter_bits(part.data)[inside], grams[inside]
                own = langs[part.first : part.first + part.rows]
                for lang in set(own):
                    at = (own == lang)[spread]
                    held = sums.setdefault(lang, (np.zeros(BUCKETS, np.int64), np.zeros(len(SCRIPTS) + 1, np.int64)))
                    held[0][:] += np.bincount(grams[at], minlength=BUCKETS)
                    held[1][:] += [int((bits[at] >> k & 1).sum()) for k in range(len(SCRIPTS) + 1)]
        rows = list(sums.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1][0].tobytes() for r in rows], pa.binary()), pa.array([r[1][1].tobytes() for r in rows], pa.binary())], ["lang", "grams", "scripts"]
        )

    got = sample.mapInArrow(count, "lang string, grams binary, scripts binary").collect()
    names = sorted({r.lang for r in got})
    grams, scripts = np.zeros((len(names), BUCKETS)), np.zeros((len(names), len(SCRIPTS) + 1))
    for r in got:
        grams[names.index(r.lang)] += np.frombuffer(r.grams, np.int64)
        scripts[names.index(r.lang)] += np.frombuffer(r.scripts, np.int64)
    return Model(names, grams, scripts)


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY, spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score and, if wanted, spans (first word, number of words, lang)."""
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.of(*shared.value)
        for batch in batches:
            rows = batch.num_rows
            preds, shares, found = [UND] * rows, np.zeros(rows), [[] for _ in range(rows)]
            if m.names:
                path, letters, bounds = _labelled(batch.column(1), m, penalty)
                row = np.repeat(np.arange(rows), np.diff(bounds))
                counts = np.bincount(row * len(m.names) + path, letters, rows * len(m.names)).reshape(rows, -1)
                total = counts.sum(axis=1)
                top = counts.argmax(axis=1)
                for r in np.flatnonzero(total > 0):
                    preds[r] = m.names[top[r]]
                    shares[r] = counts[r, top[r]] / total[r]
                if spans and len(path):
                    new = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (row[1:] != row[:-1])]))
                    for a, b in zip(new, np.append(new[1:], len(path))):
                        if total[row[a]]:
                            found[row[a]].append({"first": int(a - bounds[row[a]]), "words": int(b - a), "lang": m.names[path[a]]})
            out = [batch.column(0), pa.array(preds, pa.string()), pa.array(shares)]
            if spans:
                out.append(pa.array(found, pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "lang_pred", "score", "spans"][: len(out)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", spans array<struct<first: int, words: int, lang: string>>" if spans else ""
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double{more}")
