"""Main text of web pages by tag-path ratios.

A page is cut into blocks, each with its root-to-leaf path of block tags (with class and id, so that
``div.x`` is not ``div``); inline tags do not end a block.  Blocks inside elements that HTML itself sets apart from
the article - nav, footer, aside, form, script, style and the like, or a page's header - are left out.  For the others:

1. Text length, punctuation and text in links are aggregated per path; the path's ratios are length and punctuation
   for each of its blocks (``path_ratios``).
2. Both ratios are smoothed along the page, so a short path among long ones gains and a lone sentence loses.
3. They are fused to one score a path: length, times punctuation, times the share outside links, times a prior.
   An element marked by role, class or id lowers the score of what it holds, an
   article or main raises it.  A mark around the whole page lowers all scores alike and so changes nothing.
4. Paths whose score reaches a share of the spread of all scores select the content nodes.

The smallest container of all selected blocks (the article or main around it, if any; a list or table is none) is
the article.  Short blocks in it - headings, list items, cells - have paths of their own that need not be selected: they
stay if no element around them inside the container is marked, they are not mostly links, and their score is not next to
nothing.  A paragraph, quotation, cell or the like that is marked itself stays if without the mark its score would select it: names
do not remove a sentence that reads like the rest.  Names of inline elements do not count at all; only what is not shown
(``hidden``, ``display:none``) or is no text (buttons, forms) is cut out of a block.
A page's only h1, if it stands before the text, is its first line.

Character references are decoded, white space inside a block becomes one space (``br`` is white space),
blocks are trimmed and joined in page order by one line feed; empty blocks are left out.

Null or empty html gives an empty text; so does a page of links and set-apart elements only.  Paths that tie are
selected alike.  Broken markup never fails: unclosed elements end with their parents, a stray ``<`` is text, an end tag
without its start is ignored, and quotes that stay open do not hide tags.  Time and memory are in proportion to the
page, however long or deep it is.  Each row is judged by itself, so repeated rows need no rule.  An empty table gives
an empty result.  Other columns pass through; one that has the name of the result is replaced.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folioforge.llm.shared import modest_batches

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*+")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Tags whose open quotes were looked for in vain, after which quotes in a page are not heeded any more.
_OPEN_QUOTES = 8
# HTML's void, raw-text, block-level and set-apart elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset(
    "applet aside audio button canvas datalist dialog footer form head iframe input map menu nav noscript object option script select "
    "style svg template textarea title video".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NO_CONTAINER = HEADINGS | frozenset("p li td th pre blockquote dd dt ul ol dl table thead tbody tfoot tr caption".split())
TEXTS = HEADINGS | frozenset("p blockquote pre li dd dt td th figcaption".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: A class or id with one of these words (split at anything but letters) marks boilerplate; it lowers a score, no more.
MARKS = frozenset(
    "ad ads adsense advert advertisement advertising adverts advertorial banner breadcrumb breadcrumbs comment commentlist comments "
    "consent cookie cookies copyright dfp disqus disclaimer footer gdpr header login masthead menu menus modal nav navbar navigation "
    "newsletter notice notices notification overlay pager pagination popup popups promo promoted promotion recommended related "
    "respond searchbox share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
_CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body", "head"}
_SIBLINGS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LIMITS = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
_PUNCTUATION = re.compile(r"[.,;:!?…、。，！；？]")
WALLS = frozenset("article main body table".split())
#: Gaussian smoothing over this many blocks each side, with half of that as its deviation.
RADIUS = 1
#: A path is content if its fused score reaches this share of the page's standard deviation.
THRESHOLD = 0.75
#: What the score of a marked element's path is multiplied by, and that of a path in an article or main.
MARKED, IN_ARTICLE = 0.05, 4.0
#: Least share of the best score, and most share of links, of an unselected path that stays inside the container.
FLOOR, MOST_LINKS = 0.004, 0.5


class _Node:
    """An element: its place in page order, nearest block (itself included), path, and what is around it."""

    __slots__ = ("article", "at", "header", "holder", "link", "marked", "marks", "out", "parent", "path", "tag")

    def __init__(self, at, tag, parent, path, marks, marked, out, link, article, header):
        self.at, self.tag, self.parent, self.path, self.marks, self.marked, self.out = at, tag, parent, path, marks, marked, out
        self.link, self.article, self.header = link, article, header
        self.holder = self if parent is None or tag in BLOCK else parent.holder


class _Block:
    __slots__ = ("links", "node", "text")

    def __init__(self, text, node, links):
        self.text, self.node, self.links = text, node, links


def _marked(attributes: str) -> tuple[str, bool, bool]:
    """(class and id as part of a path, whether they or the role mark boilerplate, whether the element is not shown)."""
    names, bad, unseen = [], False, False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            names.append(value)
            bad = bad or not MARKS.isdisjoint(re.split(r"[^a-z]+", value))
        elif name == "role":
            bad = bad or value in ROLES
        elif name == "aria-hidden":
            bad = bad or value == "true"
        elif name == "style":
            unseen = unseen or "display:none" in value.replace(" ", "")
        elif name == "hidden":
            unseen = True
    return ".".join(names), bad, unseen


def _decode(piece: str) -> str:
    if "&" not in piece:
        return piece
    try:
        return html.unescape(piece)
    except ValueError:  # a number too long for Python stands for no character
        return html.unescape(re.sub(r"&#(?:[0-9]{20,}|[xX][0-9a-fA-F]{20,});?", "\ufffd", piece))


class _Page:
    """The elements and blocks of a page, from one pass over it.

    The open elements are a stack; for each tag the places where it is open are kept, so that no end tag has to
    look through the stack.
    """

    def __init__(self, page: str):
        root = _Node(0, "", None, 0, 0, False, False, False, False, False)
        self.nodes, self.blocks = [root], []
        self.stack, self.places, self.open_blocks, self.walls = [root], {}, [], []
        self.paths: dict[tuple, int] = {}
        self.names: dict[str, tuple[str, bool, bool]] = {}
        self.holder, self.texts, self.links = root, [], 0
        self._read(page)
        self._end()

    def _end(self) -> None:
        text = " ".join("".join(self.texts).split())
        if text:
            self.blocks.append(_Block(text, self.holder, min(self.links, len(text))))
        self.texts, self.links = [], 0

    def _text(self, piece: str) -> None:
        if not piece:
            return
        node = self.stack[-1]
        if node.out > node.holder.out:
            return  # an inline element that is no text, or not shown, inside a block
        self.holder = node.holder
        piece = _decode(piece)
        self.texts.append(piece)
        if node.link:
            self.links += len(piece.strip())

    def _cut(self, place: int) -> None:
        """Close all elements from ``place`` of the stack on."""
        if self.open_blocks and self.open_blocks[-1] >= place:
            self._end()
        while len(self.stack) > place:
            node = self.stack.pop()
            self.places[node.tag].pop()
        for held in (self.open_blocks, self.walls):
            while held and held[-1] >= place:
                held.pop()

    def _last(self, tags) -> list[int]:
        """The last place where each of the tags is open."""
        return [held[-1] for t in tags if (held := self.places.get(t))]

    def _start(self, tag: str, attributes: str) -> None:
        if tag in _CLOSES_P and self.open_blocks and self.stack[self.open_blocks[-1]].tag == "p":
            self._cut(self.open_blocks[-1])
        if tag in _SIBLINGS:
            limit = max(self._last(_LIMITS[tag]), default=0)
            before = [p for p in self._last(_SIBLINGS[tag]) if p > limit]
            if before:
                self._cut(min(before))
        if tag in BLOCK:
            self._end()
        parent = self.stack[-1]
        if attributes and attributes not in self.names:
            self.names[attributes] = _marked(attributes)
        name, bad, unseen = self.names[attributes] if attributes else ("", False, False)
        out = parent.out or unseen or tag in NEVER or (tag == "header" and not parent.article)
        article = parent.article or tag in ("article", "main")
        marks, path = parent.marks + (bad and tag in BLOCK), parent.path
        if tag in BLOCK:
            path = self.paths.setdefault((path, tag, name, marks, article), len(self.paths) + 1)
        node = _Node(len(self.nodes), tag, parent, path, marks, bad, out, parent.link or tag == "a", article, parent.header or tag == "header")
        if tag in BLOCK or not attributes.rstrip().endswith("/"):
            self.nodes.append(node)
            place = len(self.stack)
            self.stack.append(node)
            self.places.setdefault(tag, []).append(place)
            if tag in BLOCK:
                self.open_blocks.append(place)
            if tag in WALLS:
                self.walls.append(place)

    def _close(self, tag: str) -> None:
        place = max(self._last((tag,)), default=0)
        # An inline end tag does not reach out of an article or a table.
        if place and (tag in BLOCK or not self.walls or self.walls[-1] < place):
            self._cut(place)

    def _read(self, page: str) -> None:
        at, size, last, vain = 0, len(page), page.rfind(">"), 0
        while at < size:
            lt = page.find("<", at)
            if lt < 0 or lt > last:
                self._text(page[at:])
                return
            self._text(page[at:lt])
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = size if end < 0 else end + 3
                continue
            if page[lt + 1] in "!?":
                at = page.find(">", lt + 2) + 1 or size
                continue
            closing = page[lt + 1] == "/"
            name = _NAME.match(page, lt + 1 + closing)
            if not name:
                self._text("<")
                at = lt + 1
                continue
            rest = _REST.match(page, name.end()) if vain < _OPEN_QUOTES else None
            vain += rest is None
            end = rest.end() if rest else page.find(">", name.end()) + 1
            tag, attributes, at = name[0].lower(), page[name.end() : end - 1], end
            if closing:
                self._close(tag)
            elif tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = close.end() if close else size
            elif tag == "hr":
                self._end()
            elif tag == "br":
                self.texts.append(" ")
            elif tag not in VOID:
                self._start(tag, attributes)


def _smooth(values: list[float]) -> list[float]:
    kernel = [math.exp(-2 * (d / RADIUS) ** 2) for d in range(RADIUS + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - RADIUS), min(len(values), i + RADIUS + 1)
        weight = [kernel[abs(j - i)] for j in range(lo, hi)]
        out.append(sum(w * v for w, v in zip(weight, values[lo:hi], strict=True)) / sum(weight))
    return out


def path_ratios(good: list[_Block]) -> dict[int, tuple[float, float, float]]:
    """(length a block, punctuation a block, share of text in links) of each path."""
    sums: dict[int, list[int]] = {}
    for b in good:
        s = sums.setdefault(b.node.path, [0, 0, 0, 0])
        s[0] += 1
        s[1] += len(b.text)
        s[2] += len(_PUNCTUATION.findall(b.text))
        s[3] += b.links
    return {p: (chars / n, points / n, links / chars) for p, (n, chars, points, links) in sums.items()}


def path_scores(good: list[_Block], ratios: dict[int, tuple[float, float, float]]) -> dict[int, float]:
    """The fused score of each path: ratios smoothed along the page, and the prior."""
    length = _smooth([ratios[b.node.path][0] for b in good])
    points = _smooth([ratios[b.node.path][1] for b in good])
    total: dict[int, list[float]] = {}
    for b, n, q in zip(good, length, points, strict=True):
        prior = MARKED**b.node.marks * (IN_ARTICLE if b.node.article else 1.0)
        s = total.setdefault(b.node.path, [0.0, 0.0])
        s[0] += n * (1 + q) * (1 - ratios[b.node.path][2]) * prior
        s[1] += 1
    return {p: v / n for p, (v, n) in total.items()}


def threshold(scores: dict[int, float]) -> float:
    """The score that selects a path: a share of the spread of all."""
    mean = sum(scores.values()) / len(scores)
    return THRESHOLD * math.sqrt(sum((v - mean) ** 2 for v in scores.values()) / len(scores))


def selected(scores: dict[int, float]) -> set[int]:
    """The paths whose score reaches the threshold."""
    least = threshold(scores)
    return {p for p, v in scores.items() if v > 0 and v >= least}


def _container(nodes: list[_Node], content: list[_Node]) -> _Node:
    """The smallest container of all content nodes, or the article or main around it."""
    inside = [0] * len(nodes)
    for n in content:
        inside[n.at] += 1
    for n in reversed(nodes):  # parents come before their children
        if n.parent is not None:
            inside[n.parent.at] += inside[n.at]
    best = nodes[max(i for i, k in enumerate(inside) if k == len(content))]
    while best.parent is not None and (best.tag in NO_CONTAINER or best.tag not in BLOCK):
        best = best.parent
    up = best
    while up is not None:
        if up.tag in ("article", "main"):
            best = up
            if up.tag == "article":
                break
        up = up.parent
    return best


def main_text(page: str | None) -> str:
    """The article's text; empty if there is none."""
    if not page:
        return ""
    read = _Page(page)
    # In an article's own header only headings belong to the text.
    good = [b for b in read.blocks if not b.node.out and (b.node.tag in HEADINGS or not b.node.header)]
    if not good:
        return ""
    ratios = path_ratios(good)
    scores = path_scores(good, ratios)
    chosen = selected(scores)
    if not chosen:
        return ""
    container = _container(read.nodes, [b.node for b in good if b.node.path in chosen])
    within = bytearray(len(read.nodes))
    for n in read.nodes:
        within[n.at] = n is container or (n.parent is not None and within[n.parent.at])
    least = threshold(scores)
    floor = FLOOR * max(scores[p] for p in chosen)

    def stays(b: _Block) -> bool:
        if b.node.path in chosen:
            return True
        if not within[b.node.at]:
            return False
        own = b.node.marked and b.node.tag in TEXTS
        if b.node.marks - own != container.marks:
            return False  # inside an element that is marked
        if own:  # the name speaks against a paragraph that reads like the others
            return scores[b.node.path] / MARKED >= least
        return (b.node.tag in HEADINGS or (ratios[b.node.path][2] <= MOST_LINKS and scores[b.node.path] >= floor))

    kept = [i for i, b in enumerate(good) if stays(b)]
    if not any(good[i].node.tag == "h1" for i in kept):
        titles = [i for i, b in enumerate(good) if b.node.tag == "h1"]
        if len(titles) == 1 and titles[0] < kept[0]:
            kept = [titles[0], *kept]
    return "\n".join(good[i].text for i in kept)


def extract(pages: DataFrame, html_col: str = "html", to: str = "text") -> DataFrame:
    """``pages`` without its html, with the main text in ``to`` (in place of a column of that name)."""
    modest_batches(pages.sparkSession, 200)
    keep = [c for c in pages.columns if c not in (html_col, to)]
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField(to, T.StringType())])

    def run(batches):
        for batch in batches:
            *cols, pages_ = batch.columns
            yield pa.RecordBatch.from_arrays([*cols, pa.array([main_text(x) for x in pages_.to_pylist()], pa.string())], schema.names)

    return pages.select(*[f"`{c}`" for c in keep], f"`{html_col}`").mapInArrow(run, schema)
