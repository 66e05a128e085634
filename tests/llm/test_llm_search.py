"""Lexical search, MinHash near-duplicates and spelling variants against brute force; foreign columns of all stages."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowhelm.llm import lexical, minhash, variants
from rowhelm.llm.jaccard import required


def texts(seed, n=60, vocabulary=80, longest=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeÉé") for _ in range(rng.randint(1, 4))) + rng.choice(["", "7", "-x"]) for _ in range(vocabulary)]
    rows = [(k * 3, rng.choice([" ", "\n", ", "]).join(rng.choices(words, k=rng.randint(0, longest)))) for k in range(n)]
    return rows + [(1000, None), (1001, ""), (1002, " - "), (None, rows[5][1]), (1004, rows[6][1]), (1004, rows[6][1]), (1005, "long " * 30_000 + rows[7][1])]


# ---- ranked lexical search -----------------------------------------------------------


@pytest.mark.parametrize("seed, k, block, shard", [(1, 10, 1 << 16, 1 << 13), (2, 3, 40, 16), (3, 10, 1, 7)])
def test_search_equals_brute_force(spark, seed, k, block, shard):
    docs = texts(seed)
    rng = random.Random(seed)
    items = [(k, " ".join(rng.choice(docs[:60])[1].split()[:12]) + " " + rng.choice(["A B", "zzz", "a a a", ""])) for k in range(12)]
    items += [(50, None), (51, "??"), (52, "nowhere"), (None, "a b"), (53, items[0][1])]
    frame = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string").repartition(5)
    asked = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    found = lexical.search(frame, asked, k, block, shard)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == lexical.brute_force(docs, items, k)


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame(texts(1), "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs.filter("text is null"), items).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 30), st.integers(1, 9)), min_size=1, max_size=80, unique_by=lambda p: p[:2]), st.integers(1, 6))
def test_intervals_find_the_best(postings, k):
    term, doc, impact = (np.array(x, np.int64) for x in zip(*postings))
    index = lexical.Shard(term, doc, impact, 31)
    repeats = np.array([1, 2, 1, 3])
    scores, found = index.search(np.arange(4), repeats, np.arange(31), k, 1)
    true = Counter()
    for t, d, i in postings:
        true[d] += i * int(repeats[t])
    assert list(zip(scores.tolist(), found.tolist())) == [(s, d) for d, s in sorted(true.items(), key=lambda x: (-x[1], x[0]))[:k]]
    low, high = np.meshgrid(np.arange(len(term)), np.arange(len(term) + 1))
    inside = low < high
    same = np.array([len(set(index.key[a:b] // 31)) == 1 for a, b in zip(low[inside], high[inside])])
    low, high = low[inside][same], high[inside][same]
    assert index.most(low, high)[1].tolist() == [index.impact[a:b].max() for a, b in zip(low, high)]


def test_search_opens_few_intervals():
    rng = np.random.default_rng(3)
    doc = np.concatenate([np.sort(rng.choice(8192, 2000, replace=False)) for _ in range(8)])
    term = np.repeat(np.arange(8), 2000)
    index = lexical.Shard(term, doc, rng.pareto(1.0, len(doc)).astype(np.int64) + 1, 8192)
    seen = []
    most = index.most
    index.most = lambda a, b: seen.append(len(a)) or most(a, b)
    index.search(np.arange(8), np.ones(8, np.int64), np.arange(8192), 10, 1)
    assert sum(seen) < 2000  # of 8192 documents


# ---- MinHash -------------------------------------------------------------------------


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)} if len(words) >= 4 else ({tuple(words)} if words else set())


def components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for a, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(a)] = min(least.get(root(a), doc_id), doc_id)
    return sorted(((doc_id, len(s), least.get(root(a)) if s else doc_id) for a, ((doc_id, _), s) in enumerate(zip(rows, sets))), key=str)


def near_copies(seed, n, edits):
    rng = random.Random(seed)
    base = [f"W{rng.randrange(400)}" for _ in range(120)]
    rows = []
    for k in range(n):
        own = base[:]
        for _ in range(rng.randint(*edits)):
            own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
        rows.append((10_000 - k, " ".join(own)))
    return rows


@pytest.mark.parametrize("edits", [(0, 3), (4, 6), (2, 9)])
def test_components_equal_brute_force(spark, edits):
    # copies of one text, near copies of which part link and part don't, and everything else
    rows = near_copies(edits[1], 150, edits) + near_copies(77, 20, (0, 2)) + texts(4) + [(5000 + k, "Exactly the same  words here") for k in range(30)]
    rows += [(6000, "exactly the same words HERE"), (6001, "x"), (6002, "x"), (6003, "x y"), (6004, "Édith É a b"), (6005, "édith É a b")]
    frame = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, node string, u int").repartition(7)
    found = minhash.near_duplicates(frame)
    got = found.collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_families_are_compared_in_blocks(spark, monkeypatch):
    rows = near_copies(9, 160, (5, 8))
    nodes = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "node long, text string")
    signed = nodes.selectExpr("node as doc_id", "0L as text_key", "text").mapInArrow(minhash._signed(4), "doc_id long, text_key long, n long, class binary, u array<long>, v array<long>")
    state = signed.selectExpr("doc_id as node", "doc_id as comp", "n", "u", "v")
    links = minhash.family_links(state, nodes, 4, 80, block=20, weight=1 << 12).collect()
    sets = [shingles(t) for _, t in rows]
    true = {(a, b) for a in range(160) for b in range(160) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}

    def closed(pairs):
        group = list(range(160))
        for a, b in list(pairs) * 12:
            group[a] = group[b] = min(group[a], group[b])
        return [group[g] for g in group]

    assert closed(sorted((r.a, r.b) for r in links)) == closed(sorted(true))
    blocks = 160 // 20 + 2
    assert len(links) <= 160 * 2 * blocks  # rows grow with the members, not with their pairs


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 25), min_size=1, max_size=12, unique=True), min_size=1, max_size=50), st.integers(1, 40))
def test_shared_shingles_equal_brute_force(sets, dense):
    sets = [sorted(s) for s in sets]
    hashes = np.array([x for s in sets for x in s], np.uint64)
    bounds = np.cumsum([0, *map(len, sets)])
    left, right = np.arange(0, len(sets), 2), np.arange(len(sets))
    before, minhash.DENSE = minhash.DENSE, dense
    try:
        both = minhash.shared_shingles(hashes, bounds, left, right)
    finally:
        minhash.DENSE = before
    apart = left[:, None] != right[None, :]  # what a set alone has isn't counted
    assert (both == [[len(set(sets[a]) & set(sets[b])) for b in right] for a in left])[apart].all()


def test_chance_to_miss_a_pair():
    assert minhash.miss(0.8) < 1e-4 and minhash.miss(0.9) < 1e-8
    rng = np.random.default_rng(1)
    caught = 0
    for _ in range(300):  # pairs of just the least similarity
        n = 90
        common = required(n, n)
        own = rng.integers(1, 1 << 63, size=2 * n - common, dtype=np.uint64)
        a, b = np.sort(own[:n]), np.sort(own[n - common :])
        keys = minhash.half_keys(minhash.minhashes(np.concatenate([a, b]), np.array([0, n, 2 * n])))
        same = keys[0] == keys[1]
        caught += same[: minhash.HALVES].any() and same[minhash.HALVES :].any()
    assert caught >= 299


def test_near_duplicates_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id int, text string")
    assert minhash.near_duplicates(empty).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, " ")], "doc_id int, text string")
    assert sorted(tuple(r) for r in minhash.near_duplicates(nothing).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


# ---- spelling variants ---------------------------------------------------------------


def misspelt(seed, n=200):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcé÷Z") for _ in range(rng.randint(4, 8))) for _ in range(60)]

    def typo(w):
        at = rng.randrange(len(w))
        return w[:at] + rng.choice(["", rng.choice("abcz"), w[at] + "q"]) + w[at + 1 :]

    rows = []
    for k in range(n):
        own = [w if rng.random() < 0.8 else typo(w) for w in rng.choices(words, weights=[1 + 30 / (1 + j) for j in range(60)], k=40)]
        rows.append((k % 150, rng.choice([" ", "-", "1", "ÿ "]).join(own)))
    return rows + [(None, rows[0][1]), (None, rows[0][1]), (7, None), (8, ""), (9, "y" * 50_000 + " Ÿ ΣΣΣΣΣΣ"), (9, ("y" * 50_000 + " ") * 3), (9, ("y" * 49_999 + " ") * 3)]


@pytest.mark.parametrize("seed, limit", [(1, variants.LIMIT), (2, 12), (3, 2)])
def test_variants_equal_brute_force(spark, seed, limit):
    rows = misspelt(seed)
    frame = spark.createDataFrame([(*r, "w", 2) for r in rows], "doc_id long, text string, word string, n int").repartition(4)
    found = variants.spelling_variants(frame, typo_every=5, limit=limit)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect()}
    assert got == variants.brute_force(rows, typo_every=5) and any(f is not None for f, *_ in got.values())


def test_variants_of_an_empty_table(spark):
    assert variants.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert variants.spelling_variants(spark.createDataFrame([(1, "few words")], "doc_id long, text string")).count() == 0


def test_roots_follow_chains(spark):
    chain = [(f"w{k}", f"w{k + 1}" if k < 20 else None) for k in range(21)]
    got = {r.word: r.root for r in variants.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {f"w{k}": "w20" for k in range(21)}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("abé", min_size=1, max_size=6), min_size=2, max_size=30, unique=True))
def test_trie_reaches_all_near_words(words):
    held = variants.Words(words)
    vectors = held.vectors()
    trie = variants.Trie(vectors)
    before, variants.DIRECT = variants.DIRECT, 2
    try:
        reached = {(int(row), int(w)) for leaf, rows in trie.leaves(vectors) for row in rows for w in trie.order[trie.starts[leaf] : trie.starts[leaf + 1]]}
    finally:
        variants.DIRECT = before

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    true = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if near(a, b)}
    assert true <= reached
    i, j = np.meshgrid(np.arange(len(words)), np.arange(len(words)))
    found = held.near(i.ravel(), j.ravel())
    assert {(int(a), int(b)) for a, b in zip(i.ravel()[found], j.ravel()[found])} == true


# ---- stages of the pipeline ----------------------------------------------------------

CLASHING = [
    "n_words", "n_removed", "kept_text", "_gone", "_id", "_key", "_chosen", "_kept_0", "_copy", "_foreign", "row", "rows", "node", "class", "set", "first",
    "component", "component_id", "rate", "p", "p_en", "n_tokens", "rule", "base_failed", "kept", "anchor", "text_key", "a.b", "x`y", "n", "label", "domain",
]


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_foreign_columns_of_any_name(spark, stage, tmp_path):
    import corpus_pipeline as pipeline

    rng = random.Random(stage)
    rows = []
    for k in range(40):
        own = " ".join(f"word{rng.randrange(3000)}" for _ in range(60))
        text = rows[k - 1][1] if k % 10 == 9 else own
        rows.append((k, text, "en", "s", len(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    wide = docs
    for c in CLASHING:
        wide = wide.withColumn(c, docs["doc_id"] * 100 + len(c))
    wide = wide.select("_gone", *(x for x in wide.schema.names if x not in ("_gone", "a.b", "x`y")), "`a.b`", "`x``y`")
    spark.createDataFrame([(k, k % 2, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    name, function = pipeline.STAGES[stage]
    out = function(spark, wide, str(tmp_path))
    assert out.columns == wide.columns
    got = out.collect()
    assert got and all(r[c] == r["doc_id"] * 100 + len(c) for r in got for c in CLASHING)
    plain = function(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted((r["doc_id"], r["text"]) for r in plain)


def test_of_repeated_rows_the_first_in_order_stays(spark):
    from rowhelm.llm import jaccard

    rows = [(1, "some words that are repeated here", n) for n in (3, 1, 2)] * 2
    assert [r["n"] for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(3)).collect()] == [1]
