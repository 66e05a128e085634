"""What operators write while they run, and the exact counts that keep it small."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from rowhelm.llm import jaccard, postings, sketch, storage


def size_of(folder):
    return sum(p.stat().st_size for p in folder.rglob("*.parquet"))


@pytest.fixture
def folder(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(storage._own, spark.sparkContext.applicationId, str(tmp_path))
    return tmp_path


def distinct_texts(n, words):
    rng = random.Random(8)
    return [(i, " ".join(f"{rng.getrandbits(40):010x}" for _ in range(words))) for i in range(n)]


def test_jaccard_keeps_no_sets_of_documents_without_partners(spark, folder, monkeypatch):
    monkeypatch.setattr(sketch, "cells_for", lambda *_: 1 << 16)  # as if the table were far larger than the sketch
    rows = distinct_texts(400, 1500)
    rows += [(1000, rows[7][1]), (1001, rows[9][1] + " more")]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i for i in range(400)} | {1000: 7, 1001: 9}
    assert size_of(folder) < 0.1 * sum(len(t) for _, t in rows)


@pytest.mark.parametrize("seed", range(12))
def test_stars_join_all_partners(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(postings, "GROUP", 60)
    monkeypatch.setattr(postings, "COUNTED", np.uint64(int((1 << 64) * rng.choice([0.25, 0.4, 0.8]))))
    common = rng.integers(0, 1 << 64, 40, np.uint64)
    sets = []
    for _ in range(60):
        if sets and rng.random() < 0.5:
            own = sets[rng.integers(len(sets))]
            own = np.concatenate([own[rng.random(len(own)) > rng.choice([0, 0.1, 0.3])], rng.integers(0, 1 << 64, rng.integers(0, 3), np.uint64)])
        else:
            own = np.concatenate([rng.integers(0, 1 << 64, rng.integers(0, 40), np.uint64), common[rng.random(40) < rng.choice([0, 0.2, 0.9])]])
        sets.append(np.unique(own))
    shards, rows, groups = 5, [], [postings.Group(3, 5)]
    numbers = []
    for own in sets:
        n = len(own)
        first = np.array([n + 1 - -(-80 * n // 100)])
        numbers += groups[-1].add(own, np.array([0, n]), [own.tobytes()], first).tolist()
        if groups[-1].full():
            groups.append(postings.Group(3 + len(groups), shards))
    for group in groups:
        if group.sets:
            rows += [(group.number, *pair) for pair in zip(*group.lists())]
    lists = pd.DataFrame(rows, columns=["g", "shard", "blob"])
    of_shards = [x for _, x in lists[lists["shard"].notna()].groupby("shard")]
    answers = pd.concat([postings._frequencies(x) for x in of_shards])
    heads = lists[lists["shard"].isna()]
    quotas = pd.concat([postings._quotas(x) for _, x in pd.concat([heads, answers]).groupby("g")])
    links = pd.concat([postings._stars(pd.concat([x.assign(quota=None), quotas[quotas["shard"] == x["shard"].iloc[0]].assign(blob=None)])) for x in of_shards])
    parent = {x: x for x in numbers}
    for a, b in zip(links["a"].tolist(), links["b"].tolist()):
        a, b = jaccard.find(parent, a), jaccard.find(parent, b)
        parent[max(a, b)] = min(a, b)
    least = {}
    for number, own in zip(numbers, sets):
        least[own.tobytes()] = min(number, least.get(own.tobytes(), number))
    for a, x in zip(numbers, sets):
        for b, y in zip(numbers, sets):
            both = len(np.intersect1d(x, y))
            if both and 100 * both >= 80 * (len(x) + len(y) - both):
                assert jaccard.find(parent, least[x.tobytes()]) == jaccard.find(parent, least[y.tobytes()])
    often = Counter(h for own in sets for h in own.tolist())
    for a, x in zip(numbers, sets):
        if all(often[h] == 1 for h in x.tolist()):
            assert jaccard.find(parent, a) == a


def test_squeezed_arrays_come_back():
    arrays = [np.array([], np.int64), np.array([0, 255, 256]), np.array([1 << 37, 5, 1 << 40])]
    assert [x.tolist() for x in postings.opened(postings.squeezed(*arrays))] == [x.tolist() for x in arrays]
