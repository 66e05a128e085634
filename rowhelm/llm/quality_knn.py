"""Quality classifier: neighbours vote in a latent-semantic space.

Terms are the shapes of words (letters, capitals and digits collapsed, marks kept), hashed, with terms
for repeated words, lines and windows and for the length. Their weighted counts in at most
``max_labelled`` labelled documents (those with the smallest hash of their id) give the latent
directions (SVD). The labelled vectors, ``max_labelled`` x ``rank`` floats, are broadcast; every
document's cosines with all of them are computed exactly, a block of documents at a time, and the
``k`` nearest vote with their similarity as weight.

Nulls and empties: a null or empty text has the length term alone and gets the vote of the shortest
documents. Labels with a null id or label and labelled ids without a document teach nothing; several
labels of a document vote each. With no labels at all every score is ``NEUTRAL``. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowhelm.llm.storage import bounded_sample
from rowhelm.llm.textstats import COUNTS, row_counts
from rowhelm.llm.words import CODES, WHITE, Slice, slices, span_sums

MAX_LABELLED = 4096
SHAPES = 1024
LENGTHS = 24
EXTRA = ["n_dup_lines", "n_repeat_words", "n_symbols", "n_upper", "n_digits", "n_short_words", "n_distinct_words"]
TERMS = SHAPES + LENGTHS + len(EXTRA) + 1
RANK = 48
K = 15
THRESHOLD = 0.3
NEUTRAL = 0.5

KIND = np.arange(256, dtype=np.uint8)
KIND[97:123] = 1
KIND[128:] = 1
KIND[65:91] = 2
KIND[48:58] = 3


def terms(part: Slice) -> np.ndarray:
    """Shares of the terms in each text: rows x ``TERMS``, float32."""
    kind = KIND[part.data]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[part.starts] = True
    keep &= ~WHITE[part.data]
    place = np.zeros(len(kind) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    hashes = span_sums(CODES[0][kind[keep]], place[part.starts], place[part.ends], 0)
    row = part.row_of_word()
    shape = (hashes % np.uint64(SHAPES)).astype(np.int64)
    counts = np.bincount(row * SHAPES + shape, minlength=part.rows * SHAPES).reshape(part.rows, SHAPES)
    numbers = row_counts(part)
    n = np.maximum(1, numbers[:, :1])
    repeated = np.zeros(len(hashes) + 1, np.int64)
    words = part.word_hashes()
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    np.cumsum(same, out=repeated[1:])
    length = np.zeros((part.rows, LENGTHS))
    length[np.arange(part.rows), np.minimum(LENGTHS - 1, np.log2(numbers[:, 0] + 1).astype(int))] = 0.05
    extra = numbers[:, [COUNTS.index(c) for c in EXTRA]] / n
    extra[:, EXTRA.index("n_dup_lines")] = numbers[:, COUNTS.index("n_dup_lines")] / np.maximum(1, numbers[:, COUNTS.index("n_lines")])
    out = np.concatenate([counts / n, length, np.minimum(extra, 1), np.diff(repeated[part.bounds])[:, None] / n], axis=1)
    return np.sqrt(out).astype(np.float32)


def term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [x.tobytes() for part in slices(batch.column(0)) for x in terms(part)]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), *batch.columns[1:]], ["terms", *batch.schema.names[1:]])


class Model:
    """Latent directions and the labelled documents' unit vectors."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, rank: int = RANK, k: int = K):
        self.k, self.labels = k, labels.astype(np.float32)
        used = (x > 0).sum(axis=0)
        self.weights = (np.log((1 + len(x)) / (1 + used)) + 1).astype(np.float32)
        x = x * self.weights
        values, vectors = np.linalg.eigh(x.T.astype(float) @ x)
        self.directions = (vectors[:, ::-1][:, :rank]).astype(np.float32) * self.weights[:, None]
        self.vectors = unit((x / self.weights) @ self.directions)

    def parts(self) -> tuple:
        """What goes into a broadcast: plain values, which executors can read without this package."""
        return self.k, self.labels, self.directions, self.vectors

    @classmethod
    def of(cls, k: int, labels: np.ndarray, directions: np.ndarray, vectors: np.ndarray) -> Model:
        model = cls.__new__(cls)
        model.k, model.labels, model.directions, model.vectors = k, labels, directions, vectors
        return model

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(x), NEUTRAL)
        out, k = [], min(self.k, len(self.labels))
        for first in range(0, len(x), 512):
            cosines = unit(x[first : first + 512] @ self.directions) @ self.vectors.T
            near = np.argpartition(cosines, len(self.labels) - k, axis=1)[:, len(self.labels) - k :]
            weight = np.maximum(np.take_along_axis(cosines, near, 1), 1e-6).astype(float)
            out.append((weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1))
        return np.clip(np.concatenate(out), 0, 1) if out else np.zeros(0)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, max_labelled: int = MAX_LABELLED, rank: int = RANK, k: int = K) -> Model:
    """From at most ``max_labelled`` rows of labels (doc_id, quality) that are ``learnable``."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).dropna().filter(learnable)
    sample = F.broadcast(bounded_sample(known, "doc_id", max_labelled))
    rows = docs.select("doc_id", "text").join(sample, "doc_id").select("text", "doc_id", "quality")
    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(term_rows, f"terms binary, doc_id {kind}, quality int").collect()
    got.sort(key=lambda r: (r.doc_id, r.quality, bytes(r.terms)))
    x = np.frombuffer(b"".join(bytes(r.terms) for r in got), np.float32).reshape(-1, TERMS)
    return Model(x, np.array([r.quality == 1 for r in got], np.float32), rank, k)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())

    def run(batches):
        known = Model.of(*shared.value)
        for batch in batches:
            scores = [known.score(terms(part)) for part in slices(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
