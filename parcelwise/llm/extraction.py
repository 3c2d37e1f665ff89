"""Main text of HTML pages, by wrappers learned from the pages of a host."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written
from .urls import host_of

address = id  # of a node; parameters below are named id

MIN_PAGES = 8  # that must agree on a text before it counts as template
SHARE = 0.9  # of the distinct pages that have a place for a text; fewer make it a place that varies
LAYOUT_LEVELS = 3  # of blocks below the body that tell a host's layouts apart
BROADCAST_BYTES = 32 << 20  # of wrappers; more are joined by host

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub "
    "sup time tt u var wbr img".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
# a start tag closes an open element of these kinds, up to the nearest of those that hold them
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr"}),
    "th": ({"td", "th"}, {"tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, set()),
}
# Elements, and words of class, id and role, that never hold main text.
DROPPED = frozenset("head script style noscript template nav footer aside button select iframe svg canvas dialog menu object".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices alert popup modal overlay sidebar aside nav navbar navigation menu breadcrumb breadcrumbs footer comment comments "
    "disqus replies share sharing social related recommended newsletter subscribe subscription signup login search pagination "
    "pager widget toolbar skip complementary contentinfo dialog".split()
)
HEADERS = frozenset(("header", "masthead"))
# what may stand beside such a word in a compound name without naming something else: cookie-banner, site-footer, ad-slot
NEUTRAL = frozenset(
    "site page main global primary secondary left right top bottom upper lower inner outer box wrap wrapper container block area "
    "section bar slot unit list item items link links form panel row col column group holder module region zone title heading "
    "posts articles stories icons buttons field js u the for to in on up".split()
)
NAMED = MARKS | HEADERS | NEUTRAL
BESIDE = frozenset("with without has no".split())  # a class such as with-sidebar names what stands elsewhere
CONTROLS = frozenset("label legend textarea input datalist output".split())  # of a form; its others are in DROPPED
DEEPEST = 300  # elements nested deeper lie flat in the one at this depth
KEEPS, HARD, SOFT, HEAD, FORM = range(5)  # what a node is: kept, dropped by its element, dropped by its words, a header, a form

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[a-z]+")


class Node:
    """An element, or a text with ``tag`` None."""

    __slots__ = ("tag", "label", "kids", "text", "kind", "main", "sign")

    def __init__(self, tag: str | None, label: str = "#text", kind: int = KEEPS, main: bool = False, text: str = ""):
        self.tag, self.label, self.kind, self.main, self.text = tag, label, kind, main, text
        self.kids: list[Node] = []
        self.sign = 0


@lru_cache(4096)
def _kind(tag: str, attributes: str) -> tuple[str, int, bool]:
    """(label, kind, main) of a start tag."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):  # whole attributes, so that values aren't taken for names
        found.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    names = [set(WORDS.findall(x)) for k in ("class", "id", "role") for x in found.get(k, "").split()]
    # a name counts whole: of ad-free, share-price or menu-recipes the other word says that it is something else
    words = {w for x in names if not x & BESIDE and x <= NAMED for w in x}
    main = tag in ("article", "main") or found.get("role") in ("main", "article") or found.get("itemprop") == "articlebody"
    label = f"{tag}.{found['class']}" if found.get("class") else tag
    kind = KEEPS
    hidden = "hidden" in found or found.get("aria-hidden") == "true"
    if tag in DROPPED or hidden and tag not in ("html", "body"):
        kind = HARD
    elif tag == "form":
        kind = FORM
    elif words & MARKS and tag not in ("html", "body", "main"):
        kind = SOFT
    elif tag == "header" or words & HEADERS and not main:
        kind = HEAD
    return label, kind, main


def parsed(page: str) -> Node:
    """The tree of a page. Tags that are missing, or close nothing, are mended as browsers do in the usual cases."""
    root = Node("#root", "#root")
    open_ = [root]
    forms = False
    at, end = 0, len(page)

    def add(text: str) -> None:
        if text:
            open_[-1].kids.append(Node(None, text=html.unescape(text) if "&" in text else text))

    def close(kinds: set[str], holders: set[str]) -> None:
        for k in range(len(open_) - 1, 0, -1):
            if open_[k].tag in kinds:
                del open_[k:]
            elif open_[k].tag in holders:
                return

    while m := TAG.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:-3])
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == tag:
                    del open_[k:]
                    break
                if open_[k].main and tag in INLINE | {"p"}:
                    break
            continue
        if tag in CLOSES_P and any(n.tag == "p" for n in open_):
            close({"p"}, {"table", "button", "td", "th", "article", "main"})
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag == "html" and any(n.tag == "html" for n in open_) or tag == "body" and any(n.tag == "body" for n in open_):
            continue
        node = Node(tag, *_kind(tag, m[3]))
        open_[-1].kids.append(node)
        forms = forms or tag == "form"
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            if tag in ("textarea", "title"):
                node.kids.append(Node(None, text=page[at : stop.start() if stop else end]))
            at = stop.end() if stop else end
        elif tag not in VOID and not m[3].endswith("/") and len(open_) < DEEPEST:
            open_.append(node)
    add(page[at:])
    if forms:
        _open_forms(root)
    return root


def _open_forms(root: Node) -> None:
    """Keeps forms that wrap a page, as some servers write them, without their controls.

    They are those that hold an article or main element, or over half of the text outside parts that are always dropped.
    """
    inside: list[tuple[Node, list]] = []  # the forms and, for each, (characters, has a main part)
    total = 0
    todo: list[tuple[Node, list[list]]] = [(root, [])]
    while todo:
        n, around = todo.pop()
        if n.tag is None:
            size = len(n.text.strip())
            total += size
            for state in around:
                state[0] += size
        elif n.kind == FORM:
            inside.append((n, [0, False]))
            todo += [(k, [*around, inside[-1][1]]) for k in n.kids]
        elif n.kind != HARD and n.tag not in CONTROLS:
            for state in around:
                state[1] = state[1] or n.main
            todo += [(k, around) for k in n.kids]
    for form, (size, main) in inside:
        if main or 2 * size > total:
            form.kind = KEEPS
            todo = [(k, []) for k in form.kids]
            while todo:
                n, _ = todo.pop()
                if n.tag in CONTROLS:
                    n.kind = HARD
                elif n.tag and n.tag != "form":
                    todo += [(k, []) for k in n.kids]


def signed(node: Node) -> Node:
    """The tree with a hash of its labels below each node."""
    todo = [(node, False)]
    while todo:
        n, ready = todo.pop()
        if ready:
            n.sign = hash((n.label, *[k.sign for k in n.kids]))
        else:
            todo.append((n, True))
            n.kids = [k for k in n.kids if k.tag or not k.text.isspace()]
            todo += [(k, False) for k in n.kids]
    return node


def matched(a: Node, b: Node, memo: dict) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the most pairs of equal labels that keep order and descent, with roots paired.

    Children that are alike at the start or the end of both lists are paired at once, which loses no pair; the rest is
    the usual table over two lists.
    """
    if a.label != b.label:
        return 0, []
    key = (address(a), address(b))
    if key in memo:
        return memo[key]
    x, y, pairs, count = a.kids, b.kids, [], 1
    low, high = 0, 0
    while low < min(len(x), len(y)) and x[low].sign == y[low].sign:
        low += 1
    while high < min(len(x), len(y)) - low and x[-1 - high].sign == y[-1 - high].sign:
        high += 1
    for p, q in [*zip(x[:low], y[:low]), *zip(x[len(x) - high :], y[len(y) - high :])]:
        n, below = matched(p, q, memo)
        count += n
        pairs += [(p, q)] if not below else below
    x, y = x[low : len(x) - high], y[low : len(y) - high]
    if x and y:
        best = [[0] * (len(y) + 1)]
        for p in x:
            row, above = [0], best[-1]
            for j, q in enumerate(y):
                n = matched(p, q, memo)[0] if p.label == q.label else 0
                row.append(max(above[j + 1], row[-1], above[j] + n if n else 0))
            best.append(row)
        i, j = len(x), len(y)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs += matched(x[i], y[j], memo)[1]
        count += best[-1][-1]
    memo[key] = count, [(a, b), *pairs]
    return memo[key]


def aligned(seed: Node, page: Node) -> list[tuple[int, Node]]:
    """(number of the seed's text, the page's text) of all texts that simple tree matching pairs."""
    numbers = {address(n): k for k, n in enumerate(texts_of(seed))}
    return [(numbers[id(a)], b) for a, b in matched(seed, page, {})[1] if a.tag is None]


def texts_of(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        n = todo.pop()
        if n.tag is None:
            yield n
        todo += reversed(n.kids)


def _plain(text: str) -> str:
    return SPACE.sub(" ", text).strip()


def main_text(page: Node, template: set[int]) -> str:
    """Text of the page without blocks that are all ``template`` (by address) and parts that never hold main text.

    If the page has an article or a main element, only what is inside counts. Text inside a block is joined as it
    stands, blocks by one space. A word that all pages have inside a sentence stays with its sentence.
    """
    blocks: list[list[Node]] = [[]]
    inside = bool(regions := _regions(page))
    todo: list[Node | None] = [*reversed(regions)] or [page]
    first = {address(n) for n in todo}
    while todo:
        n = todo.pop()
        if n is None:
            blocks.append([])
        elif n.tag is None or n.tag == "br":
            blocks[-1].append(n)
        elif n.kind == KEEPS or n.kind == HEAD and inside or address(n) in first:
            if n.tag not in INLINE:
                blocks.append([])
                todo.append(None)
            todo += reversed(n.kids)
        elif n.tag not in INLINE:
            blocks.append([])
    kept = (b for b in blocks if any(n.tag is None and address(n) not in template and not n.text.isspace() for n in b))
    return _plain(" ".join("".join(" " if n.tag else n.text for n in b) for b in kept))


def _regions(page: Node) -> list[Node]:
    """The outermost articles, in page order; without any, the outermost elements marked as main; else none.

    Those inside a part that class words drop count only if there are no others.
    """
    found: dict[tuple[bool, bool], list[Node]] = {}
    todo = [(page, False, False, False)]
    while todo:
        n, soft, in_main, in_article = todo.pop()
        if n.kind in (HARD, FORM):
            continue
        soft = soft or n.kind == SOFT
        article = n.tag == "article"
        if n.main and not in_article and (article or not in_main):
            found.setdefault((soft, not article), []).append(n)
        todo += [(k, soft, in_main or n.main, in_article or article) for k in reversed(n.kids) if k.tag]
    return next((found[k] for k in ((False, False), (False, True), (True, False), (True, True)) if k in found), [])


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(_plain(text)) >> 1


def _layout(root: Node) -> int:
    """A hash of which blocks a page has near its root: the labels of its first three levels, each once."""
    found: set[str] = set()
    todo = [(root, 0)]
    while todo:
        n, depth = todo.pop()
        if n.tag and n.tag not in INLINE and n.tag != "head":
            deeper = depth + (n.tag not in ("#root", "html", "body"))
            if deeper > depth:
                found.add(f"{depth} {n.label}")
            if deeper < LAYOUT_LEVELS and not n.main:
                todo += [(k, deeper) for k in n.kids]
    return xxhash.xxh64_intdigest("\n".join(sorted(found))) >> 1


def _pages(pages: DataFrame, id: str, url: str, html: str) -> DataFrame:
    """The pages with their host, layout and a hash of the page, written so that layouts are told once."""
    text = F.coalesce(pages[html], F.lit(""))
    rows = pages.select(pages[id].alias("page_id"), pages[url].alias("url"), host_of(pages[url]).alias("host"), text.alias("html"), F.xxhash64(text).alias("page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            layouts = pa.array([_layout(parsed(x.as_py())) for x in batch["html"]], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, layouts], names=[*batch.schema.names, "layout"])

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return written(rows.mapInArrow(run, f"{shape}, layout long"), "pages")


def fitted(large: DataFrame, small: DataFrame, bytes: Column, on: list[str], how: str = "inner") -> DataFrame:
    """A join; ``small`` is broadcast if its counted bytes are at most BROADCAST_BYTES, else both are shuffled."""
    size = small.agg(F.coalesce(F.sum(bytes + 64), F.lit(0))).first()[0]
    return large.join(F.broadcast(small) if size <= BROADCAST_BYTES else small, on, how)


def seeded(pages: DataFrame, min_pages: int) -> tuple[DataFrame, DataFrame]:
    """The pages with the number of their seed, and ``(number, seed)``.

    Each layout of a host that at least ``min_pages`` distinct pages have gets a seed, its page with the smallest hash.
    Pages of rarer layouts go to the seed of the host's most frequent layout. A host with fewer pages has none.
    """
    known = pages.where("host <> '' and html <> ''").select("host", "layout", "page")
    sizes = known.groupBy("host", "layout", "page").agg(F.lit(1).alias("n")).groupBy("host", "layout")
    sizes = written(sizes.agg(F.count("*").alias("n"), F.min("page").alias("page")), "layouts")
    most = F.max_by("layout", F.struct("n", "layout"))
    hosts = sizes.groupBy("host").agg(most.alias("usual"), F.sum("n").alias("pages")).where(F.col("pages") >= min_pages).drop("pages")
    large = sizes.join(hosts, "host").where((F.col("n") >= min_pages) | (F.col("layout") == F.col("usual")))
    large = written(large.select("host", "layout", "page").withColumn("number", F.monotonically_increasing_id()), "large")
    keys = large.select("host", "layout", "number")
    usual = hosts.join(keys.withColumnRenamed("layout", "usual"), ["host", "usual"]).select("host", F.col("number").alias("other"))
    rows = fitted(pages, written(usual, "usual"), F.octet_length("host"), ["host"], "left")
    rows = fitted(rows, keys, F.octet_length("host"), ["host", "layout"], "left")
    rows = rows.withColumn("number", F.when(F.col("html") != "", F.coalesce("number", "other"))).drop("other")
    some = fitted(pages, large, F.octet_length("host"), ["host", "layout", "page"]).groupBy("number").agg(F.min("html").alias("seed"))
    return rows, written(some, "seeds")


def wrappers(rows: DataFrame, seeds: DataFrame, min_pages: int) -> DataFrame:
    """``(number, seed, template)``: the seeds with their template, as a list of (text's number, hash of the text).

    Every page is aligned with its seed by simple tree matching. A text of a seed's node is template if at least
    ``min_pages`` distinct pages and ``SHARE`` of all distinct pages that pair the node have it there; pages that have
    another text there keep theirs. The shuffle holds hashes, not pages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[int, Node] = {}
        seen: set[tuple[int, int, int, int]] = set()
        for batch in batches:
            for seed_number, seed, page, html in zip(*(batch[c].to_pylist() for c in ("number", "seed", "page", "html"))):
                if seed_number not in trees:
                    if len(trees) > 1000:
                        trees.clear()
                    trees[seed_number] = signed(parsed(seed))
                for node, found in aligned(trees[seed_number], signed(parsed(html))):
                    seen.add((seed_number, node, _hash(found.text), page))
            if len(seen) > 100_000:
                yield told(seen)
                seen = set()
        yield told(seen)

    def told(seen: set) -> pa.RecordBatch:
        names = ["number", "node", "text", "page"]
        values = sorted(seen)
        return pa.RecordBatch.from_arrays([pa.array([v[i] for v in values], pa.int64()) for i in range(len(names))], names=names)

    found = fitted(rows.where("number is not null").select("number", "page", "html"), seeds, F.octet_length("seed"), ["number"])
    counted = found.mapInArrow(run, "number long, node long, text long, page long").distinct()
    each = counted.groupBy("number", "node", "text").agg(F.count("*").alias("n"))
    nodes = each.groupBy("number", "node").agg(F.max("n").alias("most"), F.max_by("text", "n").alias("text"), F.sum("n").alias("n"))
    agreed = nodes.where((F.col("most") >= min_pages) & (F.col("most") >= SHARE * F.col("n")))
    template = agreed.groupBy("number").agg(F.collect_list(F.struct("node", "text")).alias("template"))
    return written(seeds.join(template, "number"), "wrappers")  # at most the texts of one page for each seed


def extract(
    pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES
) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row: the main text and its length in code points.

    The page is aligned with the wrapper of its layout on its host, and blocks of that template go. Of the slots that vary,
    those inside menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments go, as
    their elements or class, id and role words tell; if the page has an article or main element, the rest must be
    inside. A form that wraps the page's text loses its controls only. Character references are decoded, white space runs inside a block become one space, blocks are joined by
    one space. Nothing else is dropped, and no length is capped.

    Hosts with fewer than ``min_pages`` pages, and pages without a host, have no template. A null or empty page has the
    empty text. Repeated rows each get a row. An empty table gives an empty table. Other columns aren't used, whatever
    their names.
    """
    rows, seeds = seeded(_pages(pages, id, url, html), min_pages)
    found = wrappers(rows, seeds, min_pages)
    joined = fitted(rows, found, F.octet_length("seed"), ["number"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[int, Node] = {}
        for batch in batches:
            out = []
            for number, seed, template, page in zip(*(batch[c].to_pylist() for c in ("number", "seed", "template", "html"))):
                tree, gone = parsed(page), set()
                if template:
                    if number not in trees:
                        if len(trees) > 1000:
                            trees.clear()
                        trees[number] = signed(parsed(seed))
                    texts = {t["node"]: t["text"] for t in template}
                    gone = {address(n) for k, n in aligned(trees[number], signed(tree)) if k in texts and texts[k] == _hash(n.text)}
                out.append(main_text(tree, gone))
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(out, pa.string())], names=["page_id", "url", "text"])

    shape = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string"
    return joined.mapInArrow(run, shape).withColumn("n_chars", F.length("text").cast("long"))
