"""Main text of web pages by composite text density.

The page is parsed into a tree by a tolerant parser; every node gets its characters per tag, adjusted by
the share of linked characters, and the sum of its children's densities. The node of the largest sum
gives the main subtree, and the least density on its path to body is the threshold. Since the sum can stop
at one part of a text, the subtree grows to the node above as long as all that this adds are headings, text
of its own and parts that reach the threshold; an article or main element around it is such a node as it is.
Other branches of at least the threshold give their own node of the largest sum, grown likewise; on a page
whose main subtree stands in an article or main element only other such elements do.

Elements that are never article text (menus, headers outside the article, footers, side bars, forms,
scripts, styles, adverts, notices, comments) are cut from the tree before densities are taken, by their
element name, role, or a word of their class or id. They are closed like any other element. A word of a
class or id can be said of an article's own container too (`content has-sidebar`), so it only counts where
the element is mostly links, has less than a third of the page's text, or at most twice the text that no
such element holds; one with no other words (`ad`) goes where an article or main element without
such a mark has text.

A null or empty html gives empty text with n_chars 0; a page without main text likewise. Every row gives
one row; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that an opening tag of the key closes, if they are open in the same container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("ul ol dl table tbody thead tfoot tr select".split())
#: What a search for an element to close stops at; between two that hold there are few others, as each closes its like.
STOPS = HOLDS.union(*CLOSES.values())
NOISE_TAGS = frozenset("nav footer aside form script style noscript template iframe button select option textarea input svg canvas object embed dialog menu head title".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar aside rail widget "
    "footer header masthead topbar toolbar cookie cookies consent gdpr notice notices banner alert popup modal overlay comment comments commentlist disqus respond reply replies "
    "share sharing social related recommended newsletter subscribe subscription signup login search pagination pager skip".split()
)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("attributes", "best", "block", "children", "chars", "density", "grown", "linked", "links", "marked", "misfits", "noise", "parent", "parts", "plain", "stop", "tag", "tags", "total")

    def __init__(self, tag: str, parent: Node | None, attributes: str = "", noise: str = ""):
        self.tag, self.parent, self.attributes, self.noise = tag, parent, attributes, noise
        #: The nearest node from here up that is a block, and that STOPS names; the root if there is none.
        self.block = self if parent is None or tag in BLOCK else parent.block
        self.stop = self if parent is None or tag in STOPS else parent.stop
        self.parts: list[str | Node] = []
        self.children: list[Node] = []


def _noise(tag: str, attributes: str, inside: bool) -> str:
    """"sure" by element, role or hidden, "word" by a class or id ("words" if it has no others), or empty. inside: within an article or main element, whose own header holds the title."""
    if tag in NOISE_TAGS or tag == "header" and not inside:
        return "sure"
    if not attributes or tag in ("html", "body", "main"):
        return ""
    noisy: list[bool] = []
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in NOISE_ROLES:
            return "sure"
        if name in ("class", "id"):
            noisy += [w.lower() in NOISE_WORDS for w in WORD.findall(value)]
    return "words" if noisy and all(noisy) else "word" if any(noisy) else ""


def _cut(node: Node, kind: str) -> None:
    """Take the children of a kind of noise out of a node; a block leaves a space."""
    node.parts = [x if isinstance(x, str) or x.noise != kind else " " if x.tag in BLOCK else "" for x in node.parts]
    node.children = [x for x in node.children if x.noise != kind]


def _prune(root: Node) -> None:
    """Cut noise: sure one first, then that by a word, judged by its text, the outer element before the inner one."""
    order = [root]
    for node in order:
        if any(x.noise == "sure" for x in node.children):
            _cut(node, "sure")
        order.extend(node.children)
    if not any(x.noise for x in order):
        return
    for node in reversed(order):  # plain: text under no inner element that a word marks
        own = sum(len(x.strip()) for x in node.parts if isinstance(x, str))
        node.chars = own + sum(c.chars for c in node.children)
        node.plain = own + sum(c.plain for c in node.children if not c.noise)
        node.linked = node.chars if node.tag == "a" else sum(c.linked for c in node.children)
    free = [root]
    for node in free:
        free.extend(x for x in node.children if not x.noise)
    marked = any(x.tag in ("article", "main") and x.plain for x in free)
    plain, stack, touched = root.plain, [root], []
    while stack:
        node = stack.pop()
        if node.noise:
            touched.append(node.parent)
            if marked and node.noise == "words" or 2 * node.linked > node.chars or 3 * node.chars < root.chars or node.chars <= 2 * plain:
                node.noise = "cut"
                continue
            plain += node.plain
        stack += reversed(node.children)
    for node in {id(x): x for x in touched}.values():
        _cut(node, "cut")


def parse(page: str) -> Node:
    """The tree of a page without noise; never fails."""
    root = Node("body", None)
    at, position, inside = root, 0, 0
    opened: Counter = Counter()  # elements from the root to here by name: an end tag without a start costs no search

    def up(node: Node) -> Node:
        """Close all elements up to and including this one."""
        nonlocal at
        while True:
            opened[at.tag] -= 1
            at, last = at.parent, at
            if last is node:
                return at

    while position < len(page):
        m = TOKEN.match(page, position)
        position = m.end()
        closing, tag, attributes = m[1], m[2], m[3]
        if tag is None:
            if m[0][:2] in ("<!", "<?"):
                continue
            at.parts.append(m[0])
            continue
        tag = tag.lower()
        if closing:
            if opened[tag]:
                node = at
                while node.tag != tag:
                    inside -= node.tag in ("article", "main")
                    node = node.parent
                inside -= tag in ("article", "main")
                up(node)
            continue
        if tag in ("html", "body"):
            continue
        if tag in BLOCK and tag != "br":
            if at.block.tag == "p":  # an open paragraph ends here
                up(at.block)
            upper, node = CLOSES.get(tag), at.stop
            while upper and node is not root and node.tag not in HOLDS:
                if node.tag in upper:
                    up(node)
                    break
                node = node.parent.stop
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, position)
            position = end.start() if end else len(page)
            close = TOKEN.match(page, position) if end else None
            position = close.end() if close else position
            if tag in BLOCK:
                at.parts.append(" ")
            continue
        node = Node(tag, at, attributes, _noise(tag, attributes, inside > 0))
        at.parts.append(node)
        at.children.append(node)
        if tag not in VOID and not (attributes.endswith("/") and (tag not in BLOCK or node.noise)):
            at = node
            opened[tag] += 1
            inside += tag in ("article", "main")
    _prune(root)
    return root


def measure(root: Node) -> list[Node]:
    """Characters, tags, densities and sums of child densities; the nodes, parents first."""
    order = [root]
    for node in order:
        order.extend(node.children)
    for node in reversed(order):
        own = sum(len(entities.unescape(x).strip()) if "&" in x else len(x.strip()) for x in node.parts if isinstance(x, str))
        node.chars = own + sum(c.chars for c in node.children)
        node.tags = len(node.children) + sum(c.tags for c in node.children)
        anchor = node.tag == "a"
        node.linked = node.chars if anchor else sum(c.linked for c in node.children)
        node.links = anchor + sum(c.links for c in node.children)
    chars, linked = max(root.chars, 1), root.linked
    for node in order:
        c, plain = node.chars, max(node.chars - node.linked, 1)
        base = math.log(c * node.linked / plain + linked * c / chars + math.e) if c else 1.0
        part = (c / max(node.linked, 1)) * (max(node.tags, 1) / max(node.links, 1))
        node.density = c / max(node.tags, 1) * math.log(max(part, 1.0) + 1e-9, max(base, 1 + 1e-9)) if c else 0.0
    for node in reversed(order):
        node.total = sum(c.density for c in node.children)
    return order


def _flat(node: Node, out: list[str]) -> None:
    stack: list[Node | str] = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag in BLOCK:
            stack += [" ", *reversed(x.parts), " "]
        else:
            stack += reversed(x.parts)


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header p br hr".split())
MARKED = ("article", "main")


def _fits(node: Node, threshold: float) -> bool:
    return not node.chars or 2 * node.linked <= node.chars and (node.tag in HEADINGS or node.tag not in BLOCK or node.density >= threshold)


def _grow(order: list[Node], threshold: float) -> None:
    """Set grown of each node: itself with the headings and dense parts beside it, or the outermost article or last main around it.

    A node grows into its parent if all its siblings fit, and then as far as the parent grows, so one pass from the
    root down settles all. marked: the first main above a node, or else its outermost article.
    """
    for node in order:
        above = node.parent
        node.marked = None if above is None else above if above.tag == "main" or above.tag in MARKED and above.marked is None else above.marked
        if above is None or above.parent is None or node.tag == "main":
            node.grown = node
        elif above.tag in MARKED:
            node.grown = node.marked
        elif above.misfits == (not _fits(node, threshold)):
            node.grown = above.grown
        else:
            node.grown = above.marked or node
        node.misfits = sum(not _fits(x, threshold) for x in node.children)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    order = measure(root)
    if not root.chars:
        return ""
    main = max(order, key=lambda x: x.total)
    above, threshold = main, main.density
    while above.parent is not None:
        above = above.parent
        threshold = min(threshold, above.density)
    for node in reversed(order):  # the node of the largest sum in each subtree
        node.best = node
        for x in node.children:
            if x.best.total > node.best.total:
                node.best = x.best
    _grow(order, threshold)
    first = main.grown
    marked = {id(first)}
    for node in order:
        if first.tag in MARKED:
            if node.tag == "article" and first.tag == "article" and node.density >= threshold:
                marked.add(id(node))
        elif node.density >= threshold and node is not root:
            marked.add(id(node.best.grown))
    chosen, stack = [], [root]
    while stack:  # outermost first, in page order
        node = stack.pop()
        if id(node) in marked:
            chosen.append(node)
        else:
            stack += reversed(node.children)
    out: list[str] = []
    for node in chosen:
        out.append(" ")
        _flat(node, out)
    return " ".join(entities.unescape("".join(out)).split())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
