"""Search, packing, mixing, chat, the registered queries and the pipeline."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowhelm.llm import mixing, packing, queries, tool_calls, topk

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("chunk,block", [(8192, 1024), (16, 4)])
def test_topk_equals_brute_force(spark, chunk, block):
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=(150, 6)), 2)
    v[40:60] = v[0]  # ties
    rows = [(i, x.tolist(), "c") for i, x in enumerate(v)]
    bad = [(1000, None), (1020, [float("nan")] * 6), (1040, [None] + [1.0] * 5), (1060, [float("inf")] * 6), (1080, []), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows + [(*b, "c") for b in bad] + rows[:3], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 20 == 0, chunk=chunk, block=block).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    m = np.floor(64 * v).astype(int)
    for q in range(0, 150, 20):
        scores = m @ m[q]
        order = [i for i in np.lexsort((np.arange(150), -scores)) if i != q][:20]
        assert sorted(got[q]) == [(k + 1, i, scores[i]) for k, i in enumerate(order)]
    assert set(got) == set(range(0, 150, 20))
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def naive_fit(sizes, sources, clusters, capacity, per_source):
    bins = []
    for size, source, cluster in zip(sizes, sources, clusters):
        fits = [b for b in bins if b["left"] >= size and (cluster is None or cluster not in b["clusters"]) and (source is None or b["sources"].count(source) < per_source)]
        if not fits:
            bins.append({"left": capacity, "sources": [], "clusters": []})
            fits = [bins[-1]]
        best = min(fits, key=lambda b: b["left"])
        best["left"] -= size
        best["sources"].append(source)
        best["clusters"].append(cluster)
    return sorted(b["left"] for b in bins)


def test_best_fit_is_tightest_compatible():
    rng = random.Random(3)
    for _ in range(30):
        n = rng.randrange(60)
        sizes = sorted((rng.randrange(0, 30) for _ in range(n)), reverse=True)
        sources = [rng.choice([None, "a", "b", "c"]) for _ in range(n)]
        clusters = [rng.choice([None, 1, 2, k]) for k in range(n)]
        bins = packing.best_fit(sizes, sources, clusters, 32, 2)
        for b in set(bins):
            own = [k for k in range(n) if bins[k] == b]
            assert sum(sizes[k] for k in own) <= 32
            for values, most in ((sources, 2), (clusters, 1)):
                known = [values[k] for k in own if values[k] is not None]
                assert all(known.count(x) <= most for x in known)
        # the same rooms as by looking at all bins, if no tie decides about a conflict
        free = packing.best_fit(sizes, [None] * n, [None] * n, 32, 2)
        left = sorted(32 - sum(sizes[k] for k in range(n) if free[k] == b) for b in set(free))
        assert left == naive_fit(sizes, [None] * n, [None] * n, 32, 2)


def test_packing_keeps_all_words(spark):
    rows = [(i, " ".join(["w"] * n), f"s{i % 2}", 7) for i, n in enumerate([0, 1, 99, 100, 101, 250, 30, 30])] + [(50, None, None, 7), (None, "a b", "s", 7), (1, "w", "s1", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, bin int")
    out = packing.pack(docs, capacity=100, per_source=2).collect()
    words = {}
    for r in out:
        words[r.doc_id] = words.get(r.doc_id, 0) + r.n_tokens
    assert words == {0: 0, 1: 2, 2: 99, 3: 100, 4: 101, 5: 250, 6: 30, 7: 30, 50: 0, None: 2}
    room = {}
    for r in out:
        room.setdefault(r.bin, []).append(r)
    assert all(sum(x.n_tokens for x in own) <= 100 for own in room.values())
    same = [b for b, own in room.items() if sum(x.doc_id in (6, 7) for x in own) > 1 or sum(x.doc_id == 1 for x in own) > 1]
    assert not same  # equal texts aren't together
    assert packing.pack(docs.limit(0)).count() == 0


def test_near_copies_are_not_packed_together(spark, monkeypatch):
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(base[:59] + [f"x{i}"]), f"s{i}") for i in range(6)] + [(10 + i, f"own{i} words{i}", "s") for i in range(4)]
    rows += [(20, None, "s"), (None, " ".join(base), "t"), (21, " \n", "s"), (21, " \n", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(queries, "read_table", lambda *_: docs)
    out = queries.op6_best_fit_packing(spark, SF).collect()
    assert len(out) == len(rows)
    bins = [r.bin for r in out if r.doc_id is None or r.doc_id < 6]
    assert len(bins) == len(set(bins)) == 7
    assert len({r.bin for r in out if r.doc_id == 21}) == 2


def test_mixing_meets_targets(spark):
    rng = random.Random(6)
    letters = {"a": "abcde", "b": "uvwxy"}
    rows = [(i, " ".join("".join(rng.choice(letters[d]) for _ in range(5)) for _ in range(40)), d, 1.0) for i, d in enumerate(["a"] * 60 + ["b"] * 20)]
    rows += [(900, None, None, 1.0), (901, "", None, 1.0), (5, "abc", None, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rate double")
    labelled = docs.filter("doc_id % 2 = 0").select("doc_id", F.col("source").alias("domain"))
    out = mixing.rates(docs, labelled, {"a": 0.5, "b": 0.5}, 1.2).toPandas()
    total = out["n_tokens"].sum()
    for d in "ab":
        assert abs((out["rate"] * out["n_tokens"] * out[f"p_{d}"]).sum() / total - 0.6) < 0.01
    assert (out["rate"] >= 0).all() and len(out) == len(rows)
    again = mixing.resample(docs, labelled, {"a": 0.5, "b": 0.5}, 1.2)
    assert again.columns == docs.columns
    plain = mixing.rates(docs, labelled.limit(0), {"a": 1.0}).toPandas()
    assert (abs(plain["rate"] - 1) < 0.01).all()
    assert mixing.rates(docs.limit(0), labelled, {"a": 1.0}).count() == 0


def test_mixture_keeps_every_document(spark):
    rng = random.Random(8)
    letters = {"a": "abcd", "b": "efgh", "c": "ijkl", "d": "mnop", "e": "qrst"}
    many = ["a"] * 160 + ["b"] * 12 + ["c"] * 10 + ["d"] * 8 + ["e"] * 10  # 80 % of one, a fifth without a target
    rows = [(i, " ".join("".join(rng.choice(letters[d]) for _ in range(5)) for _ in range(40)), d) for i, d in enumerate(many)]
    docs = spark.createDataFrame(rows + [(900, None, None), (901, "", None)], "doc_id long, text string, source string")
    labelled = docs.filter("doc_id < 900").select("doc_id", F.col("source").alias("domain"))
    targets = {"a": 0.5, "b": 0.2, "c": 0.2, "d": 0.1}
    out = mixing.resample(docs, labelled, targets, 1.25).groupBy("doc_id", "source").count().toPandas()
    assert set(out["doc_id"]) == {i for i, _, _ in rows} | {900, 901}
    rated = mixing.rates(docs, labelled, targets, 1.25, keep_all=True).toPandas()
    assert (rated["rate"] >= 1).all()
    words = {d: (rated["rate"] * rated["n_tokens"] * rated[f"p_{d}"]).sum() for d in letters}
    share = rated["n_tokens"].mul(rated["p_e"]).sum() / rated["n_tokens"].sum()
    for d, target in targets.items():
        assert abs(words[d] / sum(words.values()) - target * (1 - share)) < 0.01
    assert abs(words["e"] / sum(words.values()) - share) < 0.01


def test_projection_keeps_rates_nonnegative(spark):
    rows = [(float(n), [1.0, 0.0]) for n in (10, 20)] + [(30.0, [0.0, 1.0])]
    base = spark.createDataFrame(rows, "n_tokens double, p array<double>")
    rate, _ = mixing.rate_after(mixing.fit(base, 2, [1.0, 0.0]))
    got = [r[0] for r in base.select(rate).collect()]
    assert all(abs(a - b) < 0.01 for a, b in zip(got, [2.0, 2.0, 0.0]))


def test_tool_calls(spark):
    calls = [
        ("c1", "add", {"y": "2", "x": "1"}, []), ("c2", "add", {"x": "one"}, ["c1", "c1"]), ("c3", "nope", None, ["c2", "lost"]),
        ("c4", "add", {"x": "1", "y": "3", "z": None}, ["c5"]), ("c5", "add", {"x": "1", "y": "3", "q": "é\n"}, ["c4"]), (None, "add", {}, []), ("c1", "add", {"y": "2", "x": "1"}, []),
    ]
    calls = spark.createDataFrame(calls, "call_id string, name string, arguments map<string,string>, depends_on array<string>")
    results = spark.createDataFrame([("c1", "3"), ("c1", "2"), ("zz", "0"), (None, "1")], "call_id string, content string")
    schemas = spark.createDataFrame([("add", "x", "integer", True), ("add", "y", "integer", True)], "name string, argument string, type string, required boolean")
    out = {r.call_id: r for r in tool_calls.link_calls(calls, results, schemas).collect()}
    assert {k: r.level for k, r in out.items()} == {"c1": 0, "c2": 1, "c3": 2, "c4": None, "c5": None}
    assert out["c1"].json == '{"arguments":{"x":"1","y":"2"},"id":"c1","name":"add","result":"2"}' and out["c1"].n_results == 2
    assert out["c2"].errors == "missing:y,type:x" and out["c3"].errors == "unknown tool,dependency:lost"
    assert out["c4"].errors == "cycle" and out["c5"].errors == "unknown:q,cycle" and out["c1"].valid
    assert tool_calls.link_calls(calls.limit(0), results, schemas).count() == 0


def test_chat_calls_with_null_and_repeated_ids(spark):
    rows = [(None, 0, "user", "p"), (None, 0, "user", "q"), (1, None, "user", "r"), (7, 0, "user", "b"), (7, 0, "user", "a"), (7, 0, "user", "a"), (7, 1, "assistant", "x"), (7, 2, "user", "c")]
    calls, results = queries.chat_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    schemas = spark.createDataFrame(queries.CHAT_TOOLS, "name string, argument string, type string, required boolean")
    out = [(r.call_id, r.level, json.loads(r.json)["arguments"]["prompt"], r.n_results, r.valid) for r in tool_calls.link_calls(calls, results, schemas).collect()]
    assert sorted(out) == [("7:0", 0, "a", 1, True), ("7:0", 0, "b", 1, True), ("7:2", 1, "c", 0, True)]


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = con.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    mine = [tuple(r) for r in queries.QUERIES[name](spark, SF).select(*names).collect()]
    assert sorted(mine) == sorted(result.fetchall()) and mine


@pytest.mark.parametrize("name", ["op1_source_mixing", "op6_best_fit_packing", "op7_html_extraction"])
def test_queries_cover_their_tables(spark, name):
    out = queries.QUERIES[name](spark, SF)
    table, key = ("pages", "page_id") if "op7" in name else ("documents", "doc_id")
    assert out.select(key).distinct().count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES:
        docs = pipeline.stored(stage(spark, docs, SF), name)
        seen[name] = docs
        assert name == pipeline.STAGES[-1][0] or docs.columns == columns
    counts = [seen[n].select("doc_id").distinct().count() for n, _ in pipeline.STAGES]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    words = seen["source_mixing"].selectExpr("sum(regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+')) n").first().n
    assert seen["best_fit_packing"].agg(F.sum("n_tokens")).first()[0] == words
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_levels_of_chains_branches_and_cycles(spark):
    edges = {(i, i - 1) for i in range(1, 40)} | {(i, i // 2) for i in range(41, 60)} | {(i, i - 3) for i in range(44, 60)}
    edges |= {(70, 72), (72, 71), (71, 70), (73, 70), (74, 74), (75, 73), (75, 3)} | {(76, i) for i in range(10)}
    nodes, level = {n for e in edges for n in e}, {}
    for _ in nodes:
        for n in nodes:
            needs = [b for a, b in edges if a == n]
            if all(b in level for b in needs):
                level[n] = max([level[b] + 1 for b in needs], default=0)
    calls = spark.createDataFrame([(str(n),) for n in nodes], "call_id string")
    waits = spark.createDataFrame([(str(a), str(b)) for a, b in edges], "call_id string, needs string")
    found = {int(r.call_id): r.level for r in tool_calls.levels(calls, waits).collect()}
    assert found == {n: level.get(n) for n in nodes}
