"""Main text of web pages by wrapper induction.

A page becomes a tree of its blocks. Pages of a host are aligned with one reference page of the host by
simple tree matching: roots of equal labels match, and their children are aligned in order for the most
matched nodes. Over all pages of the host, each reference node gathers how many different pages have it,
and in how many its text is the same. Constant nodes are the template; all other text of a page is its
content, wherever on the page it lies. What a page says itself comes first: ``article`` or else ``main``
elements are the content, and elements that are named as menus, notices, adverts, comments and the like
are not. Only a whole name counts, such as ``sidebar`` or ``site-footer``, not ``no-sidebar``; names that may
describe a whole page, such as ``search``, do not count on an element with most of the page's text.

Hosts of any size spread over all tasks: a page meets only its host's reference (one small row per host),
and the evidence is summed per node before it is shuffled.
"""

from __future__ import annotations

import bisect
import collections
import functools
import html as markup
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Scratch, ascii_lower

#: Elements whose content is not text, and elements that are not part of an article.
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
APART = frozenset(
    "script style textarea title noscript iframe template xmp head nav footer aside form button select option svg math"
    " dialog menu canvas audio video object".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr br img".split()
)
#: A start tag closes an open element of these, unless a structural element lies between.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("html body div article section main aside nav header footer table ul ol dl blockquote form fieldset figure details td th".split())
#: Words of class, id and role that tell what an element is there for.
PURPOSES = frozenset(
    "ad ads adv advert advertisement advertising breadcrumb breadcrumbs comment comments consent contentinfo cookie"
    " cookies disqus footer gdpr masthead menu nav navbar navigation newsletter pager pagination promo promoted"
    " sidebar sidenav sponsor sponsored subscribe subscription topbar".split()
)
#: Words that may as well tell how the whole page looks or what it is about.
LOOSE = frozenset(
    "alert banner complementary dialog hidden modal notice notices popup related search share sharing social toolbar"
    " widget widgets".split()
)
#: Words that only tell where or how, beside a purpose: ``site-footer``, ``comment-list``.
PLACES = frozenset(
    "area articles bar block bottom box button buttons container global group icons inner item items left link links"
    " list main outer page panel posts primary region right secondary section site slot sticky thread top unit wrap"
    " wrapper".split()
)
#: An element that only loose words name is content if it holds more than this share of the page's text.
LOOSE_SHARE = 0.5
#: Lists of blocks with more pairs are aligned by rows; parts of these rows that are held at a time, in pairs.
SHORT_PAIRS, PART_PAIRS = 1_000, 1 << 26
#: Evidence for a constant node: different pages, and the share with the same text; more inside an article.
PAGES, SHARE, ARTICLE_PAGES, ARTICLE_SHARE = 4, 0.8, 20, 0.95

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


class Node:
    """A block: its label, whether it is apart from articles, and its texts and blocks in order."""

    __slots__ = ("tag", "label", "apart", "items", "index")

    def __init__(self, tag: str, label: str, apart: bool | None):
        self.tag, self.label, self.apart = tag, label, apart
        self.items: list = []
        self.index = -1

    def blocks(self) -> list[Node]:
        return [x for x in self.items if isinstance(x, Node)]


def _describe(tag: str, attributes: str) -> tuple[str, bool | None]:
    """Label, and whether the element is apart; null if loose words alone say so."""
    if not attributes or "=" not in attributes:
        return tag, tag in APART
    named, names = set(), []
    for kind, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "").lower()
        named.update(_named(token) for token in value.split())
        if kind.lower() != "id":
            names.append(value)
    label = " ".join([tag, *sorted(names)])
    if tag in APART or tag in ("html", "body", "article", "main"):
        return label, tag in APART
    return label, True if PURPOSES in named else None if LOOSE in named else False


@functools.lru_cache(4096)
def _named(token: str) -> frozenset | None:
    """The list of purposes a name belongs to: all its words are of it, or of both, or tell places."""
    words = [w for w in _WORD.findall(token) if w not in PLACES]
    if not words or not all(w in PURPOSES or w in LOOSE for w in words):
        return None
    return PURPOSES if any(w in PURPOSES for w in words) else LOOSE


def parse(page: str) -> Node:
    """The blocks of a page. Any text parses; unclosed elements end where their surroundings do."""
    root = Node("#page", "#page", False)
    stack: list[tuple[str, Node]] = [("#page", root)]  # inline elements point at the block they lie in
    at = 0

    def put(text: str) -> None:
        if text:
            stack[-1][1].items.append(text)

    while True:
        found = _TAG.search(page, at)
        if found is None:
            put(page[at:])
            _settle_loose(root)
            return root
        put(page[at : found.start()])
        at = found.end()
        ends, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            continue
        tag = tag.lower()
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k][0] in SCOPE:
                    break
            continue
        label, apart = _describe(tag, attributes)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            stop = page.find(">", end.start()) if end else -1
            at = stop + 1 if stop >= 0 else len(page)
            continue
        if tag in VOID:
            if tag == "br":
                put(" ")
            elif tag == "hr":
                stack[-1][1].items.append(Node("hr", "hr", False))
            continue
        inline = tag in INLINE and apart is False
        if not inline:
            closing = CLOSES.get(tag, ())
            for k in range(len(stack) - 1, 0, -1):
                name = stack[k][0]
                if name == "p" or name in closing:
                    del stack[k:]
                    break
                if name in SCOPE and not (closing and name in ("td", "th")):
                    break
        if attributes.endswith("/") and tag not in INLINE:
            continue
        if inline:
            stack.append((tag, stack[-1][1]))
        else:
            node = Node(tag, label, apart)
            stack[-1][1].items.append(node)
            stack.append((tag, node))


def _settle_loose(root: Node) -> None:
    """Elements that only loose words name are apart, unless most of the page's text lies in them."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        if node.apart is not True:
            todo += node.blocks()
    if all(node.apart is not None for node in order):
        return
    chars: dict[int, int] = {}
    for node in reversed(order):
        own = sum(len(x.strip()) for x in node.items if isinstance(x, str))
        chars[id(node)] = 0 if node.apart else own + sum(chars[id(b)] for b in node.blocks())
    for node in order:
        if node.apart is None:
            node.apart = chars[id(node)] <= LOOSE_SHARE * chars[id(root)]


def own_text(node: Node) -> str:
    return " ".join(markup.unescape("".join(x if isinstance(x, str) else "\n" for x in node.items)).split())


def numbered(root: Node) -> list[Node]:
    """The blocks in page order, each with its number."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        node.index = len(out)
        out.append(node)
        todo += reversed(node.blocks())
    return out


# ---- Simple tree matching --------------------------------------------------------------------------


def align(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Matched nodes of two trees of equal root labels, for the most matches in order.

    How two nodes match depends on their shapes alone, which are their labels and the shapes of their blocks.
    So each two shapes are worked off once, and equal ones match whole. All blocks of a list meet all of the other.
    """
    numbers: dict[tuple, int] = {}
    labels, sizes, below, inner = [], [], [], []  # by shape
    shape: dict[int, int] = {}
    blocks: dict[int, list[Node]] = {}
    for root in (a, b):
        for node in reversed(numbered(root)):
            blocks[id(node)] = children = node.blocks()
            key = node.label, tuple([shape[id(x)] for x in children])
            shape[id(node)] = number = numbers.setdefault(key, len(numbers))
            if number == len(labels):
                labels.append(node.label)
                sizes.append(1 + sum([sizes[k] for k in key[1]]))
                below.append(key[1])
                inner.append([k for k in dict.fromkeys(key[1]) if below[k]])
    made: list[dict[int, int]] = [{} for _ in labels]  # weights of two shapes with blocks

    def weigh(p: int, q: int) -> int:
        if p == q:
            return sizes[p]
        return made[p].get(q, 1) if labels[p] == labels[q] else 0

    todo = [(shape[id(a)], shape[id(b)], False)]
    while todo:
        x, y, ready = todo.pop()
        if x == y or y in made[x]:
            continue
        if ready:
            short = len(below[x]) * len(below[y]) <= SHORT_PAIRS
            most = _most(below[x], below[y], weigh) if short else _Rows(below[x], below[y], labels, sizes, made).most()
            made[x][y] = most + 1
            continue
        todo.append((x, y, True))
        left, right = inner[x], inner[y]
        if len(below[x]) * len(below[y]) > SHORT_PAIRS:
            i0, i1, j0, j1 = _between(below[x], below[y], 0, len(below[x]), 0, len(below[y]))
            left = [k for k in dict.fromkeys(below[x][i0:i1]) if below[k]]
            right = [k for k in dict.fromkeys(below[y][j0:j1]) if below[k]]
        todo += [(p, q, False) for p in left for q in right if p != q and labels[p] == labels[q] and q not in made[p]]
    out, found, places = [], [(a, b)], {}
    while found:
        x, y = found.pop()
        out.append((x, y))
        p, q = shape[id(x)], shape[id(y)]
        left, right = blocks[id(x)], blocks[id(y)]
        if p == q:
            found += zip(reversed(left), reversed(right), strict=True)
        elif left and right:
            if (p, q) not in places:
                short = len(left) * len(right) <= SHORT_PAIRS
                places[p, q] = _in_order(below[p], below[q], weigh) if short else _Rows(below[p], below[q], labels, sizes, made).matched()
            found += [(left[i], right[j]) for i, j in reversed(places[p, q])]
    return out


def _most(left: tuple[int, ...], right: tuple[int, ...], weigh: Callable[[int, int], int]) -> int:
    """The most weight in order."""
    best = [0] * (len(right) + 1)
    for p in left:
        before = top = 0
        for j, q in enumerate(right, 1):
            above = best[j]
            top = max(top, above, before + weigh(p, q))
            before, best[j] = above, top
    return best[-1]


def _in_order(left: tuple[int, ...], right: tuple[int, ...], weigh: Callable[[int, int], int]) -> list[tuple[int, int]]:
    """Places of the blocks that match, for the most weight in order.

    ``steps`` are the ends of the best chains so far: the k-th ends furthest left. A chain's weight rises with
    its end, so a block's best predecessor is found by bisection whatever the length of the lists.
    """
    ends: list[int] = []  # places in ``right``, rising, with strictly rising weights
    steps: list[tuple] = []  # (weight, chain) at these places; a chain is (match, chain before) or null
    for i, p in enumerate(left):
        found = []
        for j, q in enumerate(right):
            more = weigh(p, q)
            if not more:
                continue
            at = bisect.bisect_left(ends, j)
            weight, chain = steps[at - 1] if at else (0, None)
            found.append((j, weight + more, ((i, j), chain)))
        for j, weight, chain in found:
            at = bisect.bisect_left(ends, j)
            same = at < len(ends) and ends[at] == j
            if steps and (steps[at][0] if same else steps[at - 1][0] if at else 0) >= weight:
                continue
            stop = at
            while stop < len(ends) and steps[stop][0] <= weight:
                stop += 1
            ends[at:stop], steps[at:stop] = [j], [(weight, chain)]
    chain = steps[-1][1] if steps else None
    matched = []
    while chain:
        matched.append(chain[0])
        chain = chain[1]
    return matched[::-1]


def _between(left: tuple[int, ...], right: tuple[int, ...], i0: int, i1: int, j0: int, j1: int) -> tuple[int, int, int, int]:
    """Of parts of two lists, what lies between equal shapes at both ends."""
    while i0 < i1 and j0 < j1 and left[i0] == right[j0]:
        i0, j0 = i0 + 1, j0 + 1
    while i0 < i1 and j0 < j1 and left[i1 - 1] == right[j1 - 1]:
        i1, j1 = i1 - 1, j1 - 1
    return i0, i1, j0, j1


class _Rows:
    """As ``_most`` and ``_in_order``, for long lists: a row of best weights per block of ``left``, worked off at once.

    Equal shapes at both ends match. What lies between is halved until the directions of a part, two bits a
    pair, stay below ``PART_PAIRS``, so that memory does not grow with the pairs.
    """

    def __init__(self, left: tuple[int, ...], right: tuple[int, ...], labels: list[str], sizes: list[int], made: list[dict[int, int]]):
        self.left, self.right, self.labels, self.sizes, self.made = left, right, labels, sizes, made
        self.places = {q: k for k, q in enumerate(dict.fromkeys(right))}
        self.named: dict[str, list[int]] = {}
        for q, k in self.places.items():
            self.named.setdefault(labels[q], []).append(k)
        self.column = np.array([self.places[q] for q in right], dtype=np.int64)
        self.weights = functools.lru_cache(64)(self._weights)

    def _weights(self, p: int) -> np.ndarray:
        row = np.zeros(len(self.places), dtype=np.int64)
        row[self.named.get(self.labels[p], [])] = 1
        for q, weight in self.made[p].items():
            if q in self.places:
                row[self.places[q]] = weight
        if p in self.places:
            row[self.places[p]] = self.sizes[p]
        return row[self.column]

    def _rows(self, ps: Sequence[int], j0: int, j1: int, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Best weights up to each place, before and with each block."""
        best = np.zeros(j1 - j0 + 1, dtype=np.int64)
        for p in ps:
            more = best.copy()
            np.maximum(best[1:], best[:-1] + self.weights(p)[j0:j1][::step], out=more[1:])
            np.maximum.accumulate(more, out=more)
            yield best, more
            best = more

    def most(self) -> int:
        i0, i1, j0, j1 = _between(self.left, self.right, 0, len(self.left), 0, len(self.right))
        total = sum(self.sizes[p] for p in self.left[:i0] + self.left[i1:])
        last = None
        for _, last in self._rows(self.left[i0:i1], j0, j1, 1):
            pass
        return total if last is None else total + int(last[-1])

    def matched(self) -> list[tuple[int, int]]:
        out, todo = [], [(0, len(self.left), 0, len(self.right))]
        while todo:
            a0, a1, b0, b1 = todo.pop()
            i0, i1, j0, j1 = _between(self.left, self.right, a0, a1, b0, b1)
            out += zip(range(a0, i0), range(b0, j0), strict=True)
            out += zip(range(i1, a1), range(j1, b1), strict=True)
            if i0 == i1 or j0 == j1:
                continue
            if i1 - i0 > 1 and (i1 - i0) * (j1 - j0) > PART_PAIRS:
                half = (i0 + i1) // 2
                for _, upper in self._rows(self.left[i0:half], j0, j1, 1):
                    pass
                for _, lower in self._rows(self.left[half:i1][::-1], j0, j1, -1):
                    pass
                cut = j0 + int((upper + lower[::-1]).argmax())
                todo += [(i0, half, j0, cut), (half, i1, cut, j1)]
                continue
            rows = self._rows(self.left[i0:i1], j0, j1, 1)
            ways = [(np.packbits(more[1:] == more[:-1]), np.packbits(more[1:] == best[1:])) for best, more in rows]
            i, j = i1 - i0 - 1, j1 - j0 - 1
            while i >= 0 and j >= 0:
                bit = 128 >> (j & 7)
                if ways[i][0][j >> 3] & bit:
                    j -= 1
                elif ways[i][1][j >> 3] & bit:
                    i -= 1
                else:
                    out.append((i0 + i, j0 + j))
                    i, j = i - 1, j - 1
        return sorted(out)


# ---- Wrappers ----------------------------------------------------------------------------------------


@functools.lru_cache(256)
def _reference(page: str) -> tuple[Node, list[Node], list[str]]:
    root = parse(page)
    nodes = numbered(root)
    return root, nodes, [own_text(n) for n in nodes]


def evidence(page: str, reference: str) -> list[tuple[int, bool]]:
    """(reference node, whether its own text is the same)."""
    root, _, texts = _reference(reference)
    return [(known.index, own_text(node) == texts[known.index]) for known, node in align(root, parse(page))]


@functools.lru_cache(256)
def wrapper(reference: str, stats: tuple[tuple[int, int, int], ...]) -> tuple[frozenset, frozenset]:
    """Constant nodes, and those so beyond doubt.

    ``stats``: (node, different pages, pages with the same text).
    """
    texts = _reference(reference)[2]
    constant, certain = set(), set()
    for node, pages, same in stats:
        if texts[node] and pages >= PAGES and same >= SHARE * pages:
            constant.add(node)
            if pages >= ARTICLE_PAGES and same >= ARTICLE_SHARE * pages:
                certain.add(node)
    return frozenset(constant), frozenset(certain)


def _articles(root: Node, tag: str) -> list[Node]:
    """The outermost elements of a tag that are not apart, in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.apart:
            continue
        if node.tag == tag:
            out.append(node)
        else:
            todo += reversed(node.blocks())
    return out


def _texts(region: Node, gone: set[int], inside: bool) -> list[str]:
    """The blocks of text below a node, without what is apart or gone; white space is one space."""
    out, run = [], []

    def end() -> None:
        text = " ".join(markup.unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    open_ = [(region, iter(region.items))]
    while open_:
        node, items = open_[-1]
        for x in items:
            if isinstance(x, str):
                if id(node) not in gone:
                    run.append(x)
                continue
            end()
            if not x.apart and (inside or x.tag != "header"):
                open_.append((x, iter(x.items)))
                break
        else:
            end()
            open_.pop()
    return out


def _template(pairs: list[tuple[Node, Node]], texts: list[str], constant: frozenset) -> set[int]:
    """The page's nodes that are matched with constant ones and have their text."""
    return {id(node) for known, node in pairs if known.index in constant and own_text(node) == texts[known.index]}


def main_text(page: str, reference: str | None, stats: tuple) -> str:
    """The blocks of all articles, one per line; without an article, all blocks that are not template."""
    root = parse(page)
    constant, certain = wrapper(reference, stats) if reference else (frozenset(), frozenset())
    template, _, texts = _reference(reference) if constant else (None, [], [])
    pairs = align(template, root) if template else []
    found = _articles(root, "article") or _articles(root, "main")
    if found:
        gone = _template(pairs, texts, certain)
        return "\n".join(text for region in found for text in _texts(region, gone, True))
    return "\n".join(_texts(root, _template(pairs, texts, constant), False))


# ---- Over tables -------------------------------------------------------------------------------------


def _host(url):
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^.*?://([^/?#]*)", 1))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: id, url, text (empty if none), n_chars.

    A null html is an empty page. Pages without a host share one host named by the empty string. Ids may be
    null or repeated; each row has a result. Pages that are copies count once as evidence.
    """
    scratch = Scratch(pages.sparkSession)
    page = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), page.alias("html"), _host(F.col(url_col)).alias("host"))
    # The reference of a host: its shortest page of at least half the usual length.
    sizes = rows.select("host", F.length("html").alias("size"), F.xxhash64("html").alias("copy"))
    usual = sizes.groupBy("host").agg((F.avg("size") / 2).alias("least"))
    chosen = scratch.keep(
        sizes.join(usual, "host").filter("size >= least").groupBy("host").agg(F.min(F.struct("size", "copy")).alias("of"))
        .select("host", F.col("of.copy").alias("copy")), "chosen",
    )
    hashed = rows.withColumn("copy", F.xxhash64("html"))
    references = hashed.join(chosen, ["host", "copy"]).groupBy("host").agg(F.first("html").alias("reference"))
    references = scratch.keep(references, "references")

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for host, page, reference, copy in zip(batch["host"], batch["html"], batch["reference"], batch["copy"], strict=True):
                out += [(host, copy, *seen) for seen in evidence(page, reference)]
            yield pd.DataFrame(out, columns=["host", "copy", "node", "same"])

    seen = hashed.join(references, "host").select("host", "copy", "html", "reference").mapInPandas(
        gather, "host string, copy bigint, node int, same boolean"
    )
    nodes = seen.groupBy("host", "node").agg(
        F.approx_count_distinct("copy", 0.02).alias("pages"),
        F.approx_count_distinct(F.when(F.col("same"), F.col("copy")), 0.02).alias("same"),
    )
    stats = nodes.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("node", "pages", "same"))).alias("stats"))
    wrappers = scratch.keep(references.join(stats, "host", "left"), "wrappers")

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for page, reference, stats in zip(batch["html"], batch["reference"], batch["stats"], strict=True):
                known = () if stats is None else tuple(tuple(s.values()) if isinstance(s, dict) else tuple(s) for s in stats)
                texts.append(main_text(page, reference, known))
            yield pd.DataFrame({"id": batch["id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    # As text, so that pandas keeps ids exact where some are null.
    kind = dict(rows.dtypes)["id"]
    wrapped = rows.join(wrappers, "host", "left").select(F.col("id").cast("string").alias("id"), "url", "html", "reference", "stats")
    done = wrapped.mapInPandas(apply, "id string, url string, text string, n_chars bigint")
    return done.select(F.col("id").cast(kind).alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
