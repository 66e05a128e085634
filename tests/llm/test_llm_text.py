"""Word operators against brute force, with planted copies, nulls, empties, ties and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from rowhelm.llm import html_text, jaccard, language_id, quality_knn, quality_rules, sketch, substring, textstats, words
from rowhelm.llm.components import connected

SCHEMA = "doc_id long, text string, n_words string, _gone int, source string, lang string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "s", "en", 0) for i, t in rows], SCHEMA)


def planted(seed=3, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{k}É" if k % 9 == 0 else f"W{k}" for k in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, base = text(60), text(200)
    rows = []
    for i in range(n):
        own = text(rng.choice([0, 1, 3, 5, 19, 20, 21, 80, 300]))
        if i % 5 == 0:
            own = own[:10] + passage + own[10:]
        if i % 7 == 0:
            own = base[:]
            for _ in range(rng.randrange(6)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(own)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "a " * 90), (n + 4, "a " * 90), (n + 5, " ".join(base)), (n + 6, "x y z")]
    return rows


def test_words_are_those_of_the_pattern():
    texts = [t for _, t in planted()]
    for part in words.slices(pa.array(texts), 500):
        for r in range(part.rows):
            raw = (texts[part.first + r] or "").encode()
            own = [bytes(part.data[a:b]) for a, b in zip(part.starts, part.ends)][part.bounds[r] : part.bounds[r + 1]]
            assert own == [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", raw.decode())]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=400), st.integers(0, 2))
def test_sketch_never_underestimates(items, extra):
    hashes = words.mix(np.array(items, np.uint64) + np.uint64(1))
    cells = 1 << 16
    dense = np.zeros(cells, np.uint8)
    for piece in np.array_split(hashes, extra + 1):
        for shard, blob in sketch._pack(piece, cells):
            size = cells // sketch.SHARDS
            sketch._add(dense[shard * size : (shard + 1) * size], blob)
    four = dense.reshape(-1, 4)
    counters = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    true = Counter(items)
    for item, low in zip(items, sketch.estimate(counters, hashes)):
        assert low >= min(3, true[item])


def test_substring_dedup_equals_brute_force(spark):
    rows = planted()
    got = {r[0]: tuple(r)[1:] for r in substring.digest(substring.remove_repeats(frame(spark, rows))).collect()}
    assert got == substring.brute_force(rows)


def test_substring_dedup_edges(spark):
    text = " ".join(f"v{k}" for k in range(30))
    twice = frame(spark, [(1, text), (1, text), (None, text), (2, text + " end")])
    out = sorted((r.doc_id is None, r.doc_id, r.n_removed) for r in substring.remove_repeats(twice).collect())
    # the null id comes first, so all others lose the passage; repeated rows fare alike
    assert out == [(False, 1, 30), (False, 1, 30), (False, 2, 30), (True, None, 0)]
    assert substring.remove_repeats(frame(spark, [])).count() == 0
    kept = substring.remove_repeats(frame(spark, [(1, "a\n b")]), untouched=True).first()
    assert kept.kept_text == "a\n b" and kept.source == "s"


def jaccard_brute(rows):
    sets = {}
    for i, text in rows:
        own = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        sets[i] = {tuple(own[k : k + 5]) for k in range(len(own) - 4)} if len(own) >= 5 else {tuple(own)} if own else set()
    parent = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = jaccard.find(parent, a), jaccard.find(parent, b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), jaccard.find(parent, i)) for i in sets}


@pytest.mark.parametrize("chunk", [jaccard.CHUNK, 400])
def test_jaccard_equals_brute_force(spark, chunk):
    rows = planted()
    got = {r[0]: tuple(r)[1:] for r in jaccard.jaccard_components(frame(spark, rows), chunk=chunk).collect()}
    assert got == jaccard_brute(rows)


def test_jaccard_edges(spark):
    assert jaccard.jaccard_components(frame(spark, [])).count() == 0
    rows = [(5, "A b c"), (3, "a B c"), (None, "a b c"), (5, "A b c"), (9, None), (8, "")]
    out = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame(spark, rows)).collect()}
    assert out == {(5, 1, 3), (3, 1, 3), (None, 1, 3), (9, 0, 9), (8, 0, 8)}
    kept = jaccard.keep_one(frame(spark, rows + [(3, "a B c")]))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 8, 9] and kept.columns == frame(spark, []).columns


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=12), min_size=1, max_size=14))
def test_t_occurrence_search_finds_all(groups):
    sets = [np.sort(words.mix(np.array(sorted(g), np.uint64))) for g in groups]
    index = jaccard.Index(sets)
    for a, own in enumerate(groups):
        want = [b for b, other in enumerate(groups) if b != a and 100 * len(own & other) >= 80 * len(own | other)]
        assert sorted(index.search(sets[a], a)) == want


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)] + [(7, None), (500, 500)]
    parent = defaultdict(lambda: None)
    for a, b in pairs:
        for x in (a, b):
            if x is not None and parent[x] is None:
                parent[x] = x
    plain = dict(parent)
    for a, b in pairs:
        if a is not None and b is not None:
            x, y = jaccard.find(plain, a), jaccard.find(plain, b)
            plain[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: jaccard.find(plain, x) for x in plain}


def base_counts(text):
    text = text or ""
    own = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(own[k : k + 5]) for k in range(len(own) - 4))
    covered = {p for k in range(len(own) - 4) if windows[tuple(own[k : k + 5])] > 1 for p in range(k, k + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é#|\n\t<", max_size=80)), max_size=6))
def test_base_counts_equal_brute_force(texts):
    counts = textstats.counts_of(pa.array(texts, pa.string()))
    assert [list(r[:5]) for r in counts] == [base_counts(t) for t in texts]


def test_quality_rules_learn_and_apply(spark):
    rng = random.Random(1)
    good = [" ".join(f"w{rng.randrange(900)}" for _ in range(40)) for _ in range(150)]
    bad = [" ".join(f"w{rng.randrange(900)}***" for _ in range(40)) for _ in range(150)]
    rows = list(enumerate(good + bad)) + [(900, None), (901, ""), (902, "few words")]
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(None, 1), (3, None)], "doc_id long, quality int")
    docs = frame(spark, rows)
    out = {r.doc_id: r for r in quality_rules.verdicts(docs, labels).collect()}
    assert all(out[i].kept == (i < 150) for i in range(300)) and not any(out[i].kept for i in (900, 901, 902))
    kept = quality_rules.keep_good(docs, labels)
    assert kept.count() == 150 and kept.columns == docs.columns
    assert quality_rules.verdicts(docs, labels.limit(0)).filter("kept").count() == 300
    assert quality_rules.verdicts(docs.limit(0), labels).count() == 0


def test_quality_classifier_held_out(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join(word() + ("" if i % 3 else "!!").upper() for _ in range(30))) for i in range(240)] + [(500, None), (501, "")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)], "doc_id long, quality int")
    from pyspark.sql import functions as F

    docs = frame(spark, rows)
    out = {r.doc_id: r.score for r in quality_knn.scored(docs, quality_knn.learn(docs, labels, F.col("doc_id") < 160)).collect()}
    assert all((out[i] >= 0.5) == (i % 3 > 0) for i in range(160, 240)) and all(0 <= s <= 1 for s in out.values())
    none = quality_knn.learn(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in quality_knn.scored(docs, none).collect()} == {quality_knn.NEUTRAL}


def test_language_spans(spark):
    from pyspark.sql import functions as F

    en, de, ru = "the and this thing with other", "der und nicht schon über straße", "это и не что как они"
    rows = [(i, " ".join(random.Random(i).choices(t.split(), k=40)), lang) for i, (t, lang) in enumerate([(en, "en"), (de, "de"), (ru, "ru")] * 30)]
    rows += [(900, "the this thing other with and " * 3 + "nicht schon über straße der und " * 4, "xx"), (901, None, "en"), (902, "12 34 !!", "en"), (903, "это THE", None), (904, "漢字", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs, F.col("doc_id") < 45)
    out = {r.doc_id: r for r in language_id.identify(docs, model, spans=True).collect()}
    assert all(out[i].lang_pred == rows[i][2] for i in range(90))
    assert [(s.first, s.words, s.lang) for s in out[900].spans] == [(0, 18, "en"), (18, 24, "de")]
    assert out[901].lang_pred == out[902].lang_pred == "und" and out[902].score == 0 and out[904].lang_pred in model.names
    empty = language_id.learn(docs, F.lit(False))
    assert {r.lang_pred for r in language_id.identify(docs, empty).collect()} == {"und"}


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(4)
    model = language_id.Model(["a", "b", "c"], np.ones((3, language_id.BUCKETS)), np.ones((3, 13)))
    import itertools

    lengths = [0, 1, 5, 3]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    scores = rng.normal(size=(sum(lengths), 3)).astype(np.float32)
    path = model.paths(scores, bounds, 0.8)
    for a, b in zip(bounds, bounds[1:]):
        value = lambda p: sum(scores[a + t, s] for t, s in enumerate(p)) - 0.8 * sum(x != y for x, y in zip(p, p[1:]))  # noqa: B023, E731
        best = max((value(p) for p in itertools.product(range(3), repeat=b - a)), default=0)
        assert abs(value(path[a:b].tolist()) - best) < 1e-5


PAGE = """<html><head><title>x</title><script>var a="</p>";</script></head><body><header><h1>Site</h1></header>
<div class="cookie-notice">We use cookies</div><ul class=menu><li><a href=/>Home</a><li><a href=/b>B</a></ul><div>Daily   paper</div>%s
<section id="comments"><p>Nice!</section><footer>(c)</footer></body>"""


def test_html_main_text(spark):
    body = "<article><h1>T&amp;t %d</h1><p>One  <b>bo</b>ld %d<p>Two<br>x &eacute; %d<p>Stays the same<aside>Side</aside><form><input>Mail</form></article>"
    plain = "<div><p>Words of page %d that are its own.</p><p>And %d more.</p></div>"
    rows = [(i, f"http://a.org/{i}", PAGE % (body % (i, i, i))) for i in range(6)]
    rows += [(10 + i, f"https://b.org/{i}", PAGE % (plain % (i, i))) for i in range(6)]
    rows += [(20, None, None), (21, "nonsense", ""), (22, "http://c.org", "just text"), (23, "http://c.org/x", "<p>" * 3000 + "deep")]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")
    out = {r.page_id: r.text for r in html_text.main_texts(pages).collect()}
    assert all(out[i] == f"T&t {i} One bold {i} Two x é {i} Stays the same" for i in range(6))  # the contract drops nothing of an article
    assert all(out[10 + i] == f"Words of page {i} that are its own. And {i} more." for i in range(6))
    assert (out[20], out[21], out[22], out[23]) == ("", "", "just text", "deep")
    assert html_text.main_texts(pages.limit(0)).count() == 0


def test_html_copies_of_an_article_keep_their_text(spark):
    page = "<nav><a href=/%d>N</a></nav><article><h1>One title</h1><p>A first paragraph.<p>A second one that is longer.%s</article>"
    rows = [(i, f"http://copies.org/{i}", page % (i, "")) for i in range(8)]
    rows += [(100 + i, f"http://mirror.org/{i}", page % (i, f"<p>Seen {i}")) for i in range(8)]  # one line differs
    rows += [(200 + i, f"http://plain.org/{i}", "<div><h2>One title</h2><p>A first paragraph.</div>") for i in range(8)]
    out = {r.page_id: r.text for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = "One title A first paragraph. A second one that is longer."
    assert all(out[i] == text and out[100 + i] == f"{text} Seen {i}" and out[200 + i] == "One title A first paragraph." for i in range(8))


@pytest.mark.parametrize("names", ["content has-sidebar", "with-nav", "search-result", "no-comments", "market-share", "sidebar", "comments"])
def test_html_article_in_a_marked_wrapper(names):
    assert html_text.extract(f"<div class='{names}'><article><p>Text</p></article></div>", None, {}) == "Text"
    plain = html_text.extract(f"<div class='{names}'><p>Text</p></div>", None, {})
    assert plain == ("" if names in ("sidebar", "comments") else "Text")


def test_html_article_in_several_elements():
    page = "<article><p>One</article><div class=comment-list><article>Nice!</article></div><div class=ad>Buy</div><article><p>Two, longer</article>"
    assert html_text.extract(page, None, {}) == "One Two, longer"
    left = ["site-footer", "cookie-notice", "comments-area", "ad-slot", "nav-primary", "related-posts", "share_buttons", "ad2", "widget-1"]
    assert not any(html_text.extract(f"<div class='x {n}'>Text</div>", None, {}) for n in left)


def test_html_main_is_whole_and_nesting_has_no_limit(spark):
    assert html_text.extract("<main><h1>T</h1><p>body</p><article>teaser</article><nav>n</nav></main>", None, {}) == "T body teaser"
    deep = "<div>" * 5000 + "<p>Deep %d" + "</div>" * 5000
    rows = [(i, f"http://deep.org/{i}", deep % i) for i in range(3)] + [(9, "http://deep.org/9", "<div>" * 4999 + "<article>Other</article>")]
    out = {r.page_id: r.text for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {0: "Deep 0", 1: "Deep 1", 2: "Deep 2", 9: "Other"}


@pytest.mark.parametrize("pages", [1, 2, 3, 6])
def test_html_template_of_small_hosts(spark, pages):
    page = "<div class=top>Welcome to the site</div><div><p>Own words of page %d</div><div>All rights reserved</div>"
    rows = [(i, f"http://small.org/{i}", page % i) for i in range(pages)]
    out = {r.page_id: r.text for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    if pages == 1:  # nothing tells its template
        assert out == {0: "Welcome to the site Own words of page 0 All rights reserved"}
    else:
        assert out == {i: f"Own words of page {i}" for i in range(pages)}  # without the wrapper all three blocks would stay


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.just([]), lambda kids: st.lists(st.tuples(st.sampled_from("abc"), kids), max_size=3), max_leaves=9), st.recursive(st.just([]), lambda kids: st.lists(st.tuples(st.sampled_from("abc"), kids), max_size=3), max_leaves=9))
def test_tree_matching_equals_brute_force(a, b):
    def tree(kids, label="r"):
        return [label, [tree(inner, own) for own, inner in kids]]

    def best(x, y):  # the largest order-keeping matching of two trees with equal root labels
        if x[0] != y[0]:
            return 0

        def pairs(p, q):
            if not p or not q:
                return 0
            return max(pairs(p[1:], q), pairs(p, q[1:]), best(p[0], q[0]) + pairs(p[1:], q[1:]))

        return 1 + pairs(x[1], y[1])

    x, y = tree(a), tree(b)
    assert html_text.match(x, y, {})[0] == best(x, y)
    forest = html_text.Forest()
    assert forest.read(html_text.written(x)) == x
    folded = html_text.fold(forest.read(html_text.written(x)), forest.read(html_text.written(y)), forest)
    assert html_text.match(folded, x, {})[0] == best(x, x) and html_text.match(folded, y, {})[0] == best(y, y)  # both are in it


def test_language_paths_and_letters():
    names = [f"l{k:03d}" for k in range(200)]
    model = language_id.Model(names, np.ones((200, language_id.BUCKETS)), np.ones((200, 13)))
    scores = np.full((4, 200), -50.0, np.float32)
    scores[:2, 150], scores[2:, 199] = 0, 0
    assert model.paths(scores, np.array([0, 4]), 1.0).tolist() == [150, 150, 199, 199]
    assert language_id.Model.of(*model.parts()).names == names
    for text, letters in [("१२३", 0), ("।", 0), ("・", 0), ("ʹ҃", 1), ("नमस्ते", 4), ("é1", 1), ("日本", 2), ("😀", 0)]:
        assert (language_id.letter_bits(np.frombuffer(text.encode(), np.uint8)) > 0).sum() == letters, text


def test_quality_labels_may_be_long(spark):
    rows = [(i, " ".join(["good words in a row"] * (1 + i % 3)) if i % 2 else "%% $$ ##", i % 2) for i in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality long")
    model = quality_knn.learn(docs, labels, F.col("doc_id") >= 10)
    scores = {r.doc_id: r.score for r in quality_knn.scored(docs, model).collect()}
    assert all((scores[i] >= 0.5) == bool(q) for i, _, q in rows)
    assert quality_knn.scored(docs.limit(0), model).count() == 0


def test_tree_matching_and_fold():
    a = ["x", [["p", []], ["q", [["r", []]]], ["p", []]]]
    b = ["x", [["q", [["r", []], ["s", []]]], ["t", []], ["p", []]]]
    assert html_text.match(a, b, {})[0] == 4
    assert html_text.fold(a, b) == ["x", [["p", []], ["q", [["r", []], ["s", []]]], ["t", []], ["p", []]]]


def test_digest_hash():
    assert hashlib.sha256(b"").hexdigest() == substring.brute_force([(1, None)])[1][2]
