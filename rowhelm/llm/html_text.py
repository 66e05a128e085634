"""HTML extraction by wrapper induction: what is constant on a host is template, slots are content.

1. Each page is read into a tree of its block elements; runs of alike siblings are one iterated
   node. The trees of a host are folded into one wrapper by simple tree matching: children are
   aligned by dynamic programming over the sizes of the matched subtrees, unmatched ones are added.
   Equal trees are folded once; a host's trees are folded in parts, then the parts.
2. The text in each node of the wrapper is counted over the distinct contents of the host's pages, so
   copies of a page count once. Text that most of them have at the same node is template; a node whose
   text varies is a slot.
3. Each page is read again beside its host's wrapper: the main text is the outermost article
   elements in page order if there are any, else the slots that aren't mostly links. Menus, forms, adverts,
   comments and the like, known by tag or by a whole class token, are left out, and so is template text outside of
   articles; article elements in what is left out by class are taken if the page has no others.

Nulls and empties: null or empty html gives empty text; text without markup is one block. A page
without a URL, or with one that has no host, has the host ''. Pages of a host with the same blocks
of text count once, whatever their URLs. What is template shows in two distinct contents at least, so a host of
one has none. Text inside an article element stays, whatever its share. Pages may be nested to any depth. An empty table gives an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowhelm.llm.storage import stored

MIN_PAGES = 2
OUTSIDE_SHARE = 0.6
PARTS = 8
# Element names by their role in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template svg xmp".split())
INLINE = set("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meta link q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
LEFT_OUT = set("head nav footer aside form button select dialog object canvas audio video map datalist menu".split()) | RAW
# Words in class, id or role that mark what isn't the article. A token counts as a whole: all its
# parts are marks, or marks and words that say nothing (site-footer, but not has-sidebar or market-share).
MARK = re.compile(
    r"(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|toast"
    r"|comments?|disqus|replies|respond|sidebar|side|widget|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|topbar|toolbar"
    r"|related|recommend\w*|share|sharing|social|subscribe|subscription|newsletter|signup|login|search|skip|pagination|pager|tags"
    r"|complementary|contentinfo)\d*",
    re.I,
)
NEUTRAL = re.compile(
    r"(?:|\d+|site|page|global|main|primary|secondary|top|bottom|header|post|posts|article|articles|entry|stories|list|items?|links?|buttons?|icons?"
    r"|area|bar|block|box|container|form|inner|module|outer|panel|section|slot|unit|wrap|wrapper)\d*",
    re.I,
)
HEADERS = re.compile(r"(?:^|[\s_-])(?:site-?)?header(?=$|[\s_-]|\d)", re.I)
MAINS = re.compile(r"(?:^|[\s_-])(?:main|article|articlebody|article-body|post-content|entry-content|post-body|content-main)(?=$|\s)", re.I)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>?", re.S)
ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


class Node:
    __slots__ = ("tag", "names", "items", "skeleton")

    def __init__(self, tag: str, names: str = ""):
        #: items: text, (text in a link,) or nodes, in page order
        self.tag, self.names, self.items, self.skeleton = tag, names, [], None


def parse(page: str) -> Node:
    root = Node("#")
    stack, at, links = [root], 0, 0
    for found in TOKEN.finditer(page):
        start = found.start()
        if start < at:
            continue
        if start > at:
            text = page[at:start]
            stack[-1].items.append((text,) if links else text)
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                links = 0 if found[1] else 1
            elif tag == "br":
                stack[-1].items.append(" ")
            continue
        if found[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    links = 0
                    break
            continue
        if tag in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    del stack[depth:]
                    break
                if stack[depth].tag not in ("span", "a"):
                    break
        elif tag in SAME:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in SAME[tag]:
                    del stack[depth:]
                    break
                if stack[depth].tag in STOPS[tag]:
                    break
        names = ""
        if found[3] and not found[3].isspace():
            names = " ".join(a or b or c for k, a, b, c in ATTRIBUTE.findall(found[3]) if k.lower() in ("class", "id", "role", "itemprop"))
        node = Node(tag, names)
        stack[-1].items.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not found[3].endswith("/"):
            stack.append(node)
            links = 0
    if at < len(page):
        stack[-1].items.append(page[at:])
    return root


class Forest:
    """Trees [label, children] in which equal subtrees are one object, so that they are compared by identity."""

    def __init__(self):
        self.known: dict = {}

    def tree(self, label: str, children: list) -> list:
        key = (label, *map(id, children))
        return self.known.setdefault(key, [label, children])

    def read(self, text: str) -> list:
        made: list = []
        for label, *children in json.loads(text):
            made.append(self.tree(label, [made[k] for k in children]))
        return made[-1]


def written(tree: list) -> str:
    """The tree as a flat list of its different subtrees, [label, numbers of the children before it...]."""
    number, rows, todo = {}, [], [tree]
    while todo:
        at = todo[-1]
        missing = [child for child in at[1] if id(child) not in number] if id(at) not in number else []
        if missing:
            todo += reversed(missing)
            continue
        todo.pop()
        if id(at) not in number:
            number[id(at)] = len(rows)
            rows.append([at[0], *(number[id(child)] for child in at[1])])
    return json.dumps(rows, separators=(",", ":"))


def skeleton(root: Node, forest: Forest) -> list:
    """[label, children]: the block elements below; a run of alike siblings is one child."""
    todo = [(root, [x for x in root.items if isinstance(x, Node)][::-1], [])]
    while True:
        node, left, children = todo[-1]
        if left:
            child = left.pop()
            todo.append((child, [x for x in child.items if isinstance(x, Node)][::-1], []))
            continue
        todo.pop()
        made = forest.tree(f"{node.tag}.{re.sub(r'[0-9]+', '0', node.names)}" if node.names else node.tag, children)
        if not todo:
            return made
        siblings = todo[-1][2]
        if not siblings or siblings[-1] is not made:
            siblings.append(made)
        node.skeleton = len(siblings) - 1


def match(a: list, b: list, known: dict) -> tuple[int, list]:
    """Simple tree matching: (matched nodes, pairs of child positions) of two trees. Pairs of subtrees wait on a stack."""
    todo = [(a, b)]
    while todo:
        x, y = todo[-1]
        key = (id(x), id(y))
        if key in known:
            todo.pop()
            continue
        if x[0] != y[0]:
            known[key] = (0, [])
            continue
        left, right = x[1], y[1]
        missing = [(p, q) for p in left for q in right if p[0] == q[0] and (id(p), id(q)) not in known]
        if missing:
            todo += missing
            continue
        best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
        for i, p in enumerate(left):
            for j, q in enumerate(right):
                both = known[id(p), id(q)][0] if p[0] == q[0] else 0
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + both)
        i, j, pairs = len(left), len(right), []
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((i, j))
        known[key] = (1 + best[-1][-1], pairs[::-1])
    return known[id(a), id(b)]


def fold(wrapper: list, tree: list, forest: Forest | None = None) -> list:
    """The wrapper with ``tree`` added: aligned children are folded, others come where they stand."""
    if wrapper is tree or wrapper[0] != tree[0]:
        return wrapper
    known: dict = {}
    match(wrapper, tree, known)
    make = (forest or Forest()).tree

    def steps(a, b):
        """What the children of the folded node are, last one first: whole subtrees, or pairs to be folded."""
        out, i, j = [], 0, 0
        for x, y in [*match(a, b, known)[1], (len(a[1]), len(b[1]))]:
            out += [(child, child) for child in a[1][i:x] + b[1][j:y]]
            if x < len(a[1]) and y < len(b[1]):
                out.append((a[1][x], b[1][y]))
            i, j = x + 1, y + 1
        return out[::-1]

    todo = [(wrapper[0], steps(wrapper, tree), [])]
    while True:
        label, left, children = todo[-1]
        if left:
            a, b = left.pop()
            if a is b:
                children.append(a)
            else:
                todo.append((a[0], steps(a, b), []))
            continue
        todo.pop()
        made = make(label, children)
        if not todo:
            return made
        todo[-1][2].append(made)


def places(wrapper: list | None, tree: list) -> list:
    """For each node of ``tree``, nested alike, its place in the wrapper ('' at the root) or None."""
    known: dict = {}
    fits = bool(wrapper) and wrapper[0] == tree[0]
    root = ["" if fits else None, []]
    todo = [(wrapper if fits else None, tree, root)]
    while todo:
        a, b, (at, inside) = todo.pop()
        inner = {y: x for x, y in match(a, b, known)[1]} if a is not None else {}
        for k, child in enumerate(b[1]):
            own = [f"{at}.{inner[k]}" if k in inner else None, []]
            inside.append(own)
            todo.append((a[1][inner[k]] if k in inner else None, child, own))
    return root


def clean(items: list) -> str:
    """Text pieces of a block as one text with single spaces."""
    text = "".join(x[0] if isinstance(x, tuple) else x for x in items)
    return " ".join((html.unescape(text) if "&" in text else text).split())


def blocks(root: Node, place: list | None) -> Iterator[tuple[str, str | None, int, Node]]:
    """(text, place, characters in links, node) of the blocks below, in page order; what is left out by tag or class isn't entered."""
    todo: list = [(root, place, iter(root.items))]
    held: list = []
    while todo:
        node, at, items = todo[-1]
        inner = None
        for item in items:
            if isinstance(item, Node):
                inner = item
                break
            held.append(item)
        if held:
            text, links = clean(held), sum(len(x[0]) for x in held if isinstance(x, tuple))
            held.clear()
            if text:
                yield text, at and at[0], links, node
        if inner is None:
            todo.pop()
        elif not left_out(inner):
            todo.append((inner, at[1][inner.skeleton] if at else None, iter(inner.items)))


_marked: dict[str, bool] = {}


def marked(names: str) -> bool:
    if names not in _marked:
        if len(_marked) > 1 << 14:
            _marked.clear()
        _marked[names] = _is_marked(names)
    return _marked[names]


def _is_marked(names: str) -> bool:
    for token in names.split():
        parts = re.split("[_-]", token)
        marks = [bool(MARK.fullmatch(x)) for x in parts]
        if any(marks) and all(m or NEUTRAL.fullmatch(x) for m, x in zip(marks, parts)):
            return True
    return False


def left_out(node: Node) -> bool:
    return node.tag in LEFT_OUT or bool(node.names and node.tag not in ("body", "html", "article", "main") and marked(node.names))


def mains(root: Node, place: list | None, within: bool = False) -> list[tuple[Node, list | None]]:
    """Outermost elements that say they hold the article, in page order; with ``within`` also article and main elements inside what is left out by class."""
    out, todo = [], [(root, place)]
    while todo:
        node, at = todo.pop()
        if node is not root and (node.tag in ("article", "main") or node.names and MAINS.search(node.names) and not left_out(node)):
            out.append((node, at))
            continue
        for item in reversed(node.items):
            if isinstance(item, Node) and (item.tag not in LEFT_OUT if within else not left_out(item)):
                todo.append((item, at[1][item.skeleton] if at else None))
    return out


def digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def extract(page: str | None, wrapper: list | None, constant: dict) -> str:
    """Main text of a page. constant: (place, digest of a block) -> share of the host's distinct contents."""
    if not page:
        return ""
    root = parse(page)
    place = places(wrapper, skeleton(root, Forest()))
    any_found = False
    # comments and teasers may be article elements too, so those inside what is left out count only if there is no other
    for within in (False, True):
        found = mains(root, place, within)
        # a site header is outside of articles; one inside holds the title
        whole = [t for x in found for t, *_ in blocks(*x)]
        if whole:
            return " ".join(whole)
        any_found = any_found or bool(found)
    if any_found:
        return ""
    kept = []
    for text, at, links, node in blocks(root, place):
        if at and constant.get((at, digest(text)), 0) >= OUTSIDE_SHARE or 2 * links > len(text):
            continue
        if node.tag == "header" or node.names and HEADERS.search(node.names):
            continue
        kept.append(text)
    return " ".join(kept)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (host, html): host, tree, for each block its node (number in page order) and digest, and a digest of all blocks."""
    for batch in batches:
        trees, nodes, digests, contents = [], [], [], []
        for page in batch.column(1).to_pylist():
            root = parse(page or "")
            tree = skeleton(root, Forest())
            numbers = _numbered(tree)
            found = [(n, digest(t)) for t, n, _, _ in blocks(root, numbers)]
            own = dict.fromkeys(found)
            contents.append(xxhash.xxh3_128_digest(",".join(str(d) for _, d in found)))
            trees.append(written(tree))
            nodes.append([n for n, _ in own])
            digests.append([d for _, d in own])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(trees, pa.string()), pa.array(nodes, pa.list_(pa.int32())), pa.array(digests, pa.list_(pa.int64())), pa.array(contents, pa.binary())],
            ["host", "tree", "nodes", "digests", "content"],
        )


def _numbered(tree: list) -> list:
    """The tree with a number in page order for each label."""
    root: list = [0, []]
    todo, count = [(tree, root)], 0
    while todo:
        node, own = todo.pop()
        count += 1
        own[0] = count
        own[1] += [[0, []] for _ in node[1]]
        todo += list(zip(node[1], own[1]))[::-1]
    return root


def _fold_rows(columns: list[str]) -> callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, wrapper, forest = None, None, Forest()
        for rows in frames:
            for *own, tree in rows[[*columns, "tree"]].itertuples(index=False):
                own = tuple(own)
                if own != key:
                    if key is not None:
                        yield pd.DataFrame([[*key, written(wrapper)]], columns=[*columns, "tree"])
                    key, forest = own, Forest()
                    wrapper = forest.read(tree)
                else:
                    wrapper = fold(wrapper, forest.read(tree), forest)
        if key is not None:
            yield pd.DataFrame([[*key, written(wrapper)]], columns=[*columns, "tree"])

    return run


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (host, tree, wrapper, nodes, digests): host, place, digest of each block."""
    known: dict = {}
    for batch in batches:
        hosts, at, digests = [], [], []
        for host, tree, wrapper, nodes, own in zip(*(c.to_pylist() for c in batch.columns)):
            key = (host, tree)
            if key not in known:
                if len(known) > 10_000:
                    known.clear()
                forest = Forest()
                tree = forest.read(tree)
                flat, todo = {}, [(_numbered(tree), places(forest.read(wrapper), tree))]
                while todo:
                    number, place = todo.pop()
                    flat[number[0]] = place[0]
                    todo += zip(number[1], place[1])
                known[key] = flat
            for node, value in zip(nodes, own):
                if known[key].get(node) is not None:
                    hosts.append(host)
                    at.append(known[key][node])
                    digests.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(at, pa.string()), pa.array(digests, pa.int64())], ["host", "place", "digest"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict = {}
    for batch in batches:
        texts = []
        for host, page, wrapper, same in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5))):
            if host not in known:
                if len(known) > 10_000:
                    known.clear()
                known[host] = (Forest().read(wrapper) if wrapper else None, {(x["place"], x["digest"]): x["share"] for x in same or ()})
            texts.append(extract(page, *known[host]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON) and constant: its blocks that most distinct contents have (place, digest, share)."""
    read = stored(pages.select("host", "html").mapInArrow(_trees, "host string, tree string, nodes array<int>, digests array<long>, content binary"), "trees")
    counts = read.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= MIN_PAGES)
    once = read.groupBy("host", "content").agg(F.min(F.struct("tree", "nodes", "digests")).alias("page")).select("host", "page.*")
    trees = read.groupBy("host", "tree").agg(F.count("*").alias("n"))
    parts = trees.withColumn("part", F.pmod(F.xxhash64("tree"), F.lit(PARTS)).cast("int"))
    parts = parts.repartition("host", "part").sortWithinPartitions("host", "part", F.desc("n"), "tree").select("host", "part", "tree")
    parts = parts.mapInPandas(_fold_rows(["host", "part"]), "host string, part int, tree string")
    whole = parts.repartition("host").sortWithinPartitions("host", "part").mapInPandas(_fold_rows(["host"]), "host string, tree string")
    found = stored(whole.withColumnRenamed("tree", "wrapper").join(counts, "host"), "wrappers")
    placed = once.join(found.select("host", "wrapper"), "host").select("host", "tree", "wrapper", "nodes", "digests")
    shares = (
        placed.mapInArrow(_placed, "host string, place string, digest long")
        .groupBy("host", "place", "digest")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= MIN_PAGES)
        .join(counts, "host")
        .withColumn("share", F.col("n") / F.col("pages"))
        .filter(F.col("share") >= OUTSIDE_SHARE)
    )
    same = shares.groupBy("host").agg(F.collect_list(F.struct("place", "digest", "share")).alias("constant"))
    return found.join(same, "host", "left").select("host", "wrapper", "constant")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page. Learns the wrappers when called."""
    own = pages.select("page_id", "url", F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit("")).alias("host"), "html")
    learned = stored(wrappers(own), "learned")
    kind = pages.schema["page_id"].dataType.simpleString()
    joined = own.join(learned, "host", "left").select("page_id", "url", "host", "html", "wrapper", "constant")
    return joined.mapInArrow(_texts, f"page_id {kind}, url string, text string")
