"""Main text of web pages by tag-path ratios.

Text is grouped by its root-to-leaf tag path. A path's text length an element and its punctuation an
element are smoothed over similar paths and fused by their geometric mean. Paths above a threshold are
content: their blocks stay. A block under the threshold stays only as part of the flow around content
(a heading, list, table or quotation beside it, or in its article) if it is no bar of links. Tags and roles
veto (menus, footers, scripts, asides); an article or main element is evidence like so many characters of
text. Class and id tell reader comments alone, whose prose no ratio tells from an article's, and only
against other text of the page.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, picked

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes plaintext".split())
#: Elements whose text is no article text, wherever they stand.
SKIPPED = frozenset("head script style noscript template iframe object embed svg math canvas audio video map button select option datalist textarea input nav footer aside dialog menu title noembed noframes".split())
#: Elements that end a block before and after them; all others are inline.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li legend main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 header hgroup".split())
#: Blocks that make up a running text; the others hold one.
FLOW = HEADINGS | frozenset("address blockquote caption dd details dir dl dt figcaption figure li ol p pre summary table tbody td tfoot th thead tr ul".split())
#: Flow that is no sentence by nature, and so may be short anywhere in an article.
SHORT_FLOW = FLOW - frozenset(("p",))
#: An open element of the first kinds is closed by a start tag of the third, unless one of the second stands between.
CLOSERS = (
    (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir")), frozenset(("li",))),
    (frozenset(("dt", "dd")), frozenset(("dl",)), frozenset(("dt", "dd"))),
    (frozenset(("td", "th")), frozenset(("tr", "table")), frozenset(("td", "th"))),
    (frozenset(("tr", "td", "th")), frozenset(("tbody", "thead", "tfoot", "table")), frozenset(("tr",))),
    (frozenset(("option",)), frozenset(("select", "datalist")), frozenset(("option",))),
    (frozenset(("p",)), frozenset("table td th caption button object html body".split()), BLOCKS - frozenset("caption td th tr tbody tfoot thead body html title legend".split())),
)
_KINDS = {tag: [i for i, c in enumerate(CLOSERS) if tag in c[0]] for c in CLOSERS for tag in c[0]}
_BOUNDS = {tag: [i for i, c in enumerate(CLOSERS) if tag in c[1]] for c in CLOSERS for tag in c[1]}
_CLOSES = {tag: [i for i, c in enumerate(CLOSERS) if tag in c[2]] for c in CLOSERS for tag in c[2]}
_COMMENTS = re.compile(r"(?:(?:reader|user|post|article|page|the|wp)[-_])?(?:comments?|commentlist|disqus)(?:[-_](?:list|area|section|box|wrap|wrapper|container|block|thread|body|content|item|text|feed))?")
_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form toolbar".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:"[^"]*"|'[^']*')?)*+)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.S)
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？]")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Width of smoothing over paths; a score at which text is text whatever more it has; power of a path's share of all
#: characters; share of the best score that content has.
SIGMA, FULL, SHARE, THRESHOLD = 1.0, 60.0, 0.3, 0.45
#: Weight of article and main, which grows by TAGS ** (CHARS / (CHARS + characters of the page)): with little text
#: there is little that ratios could tell. Weight of comments and forms; share of a block's text in links that makes a bar of links.
ARTICLE, TAGS, CHARS, REMARK, LINKS = 1.4, 64.0, 100, 0.25, 0.5
#: Share of all text that a form holds which wraps the page, and of all content that an element holds whose headings are the page's.
HELD = 0.75
#: Paths further apart than this weigh under 1e-21 of a path itself: nothing, in doubles.
REACH = 10
_WEIGHTS = [math.exp(-(d**2) / (2 * SIGMA**2)) for d in range(REACH + 1)]


def _judged(tag: str, attrs: str, inside_article: bool) -> tuple[bool, bool]:
    """(vetoed, named as reader comments) by tag, role, visibility; and by class or id."""
    if tag in SKIPPED or tag == "header" and not inside_article:
        return True, False
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return False, False
    remark = False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id") and tag not in ("html", "body", "main"):
            remark |= any(_COMMENTS.fullmatch(_CAMEL.sub("-", x).rstrip("0123456789-_").lower()) for x in html.unescape(value).split())
        if name == "role" and value.lower() in _ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, remark
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, remark
    return False, remark


class _Node:
    """An open or closed element. `box` is the nearest block at or above it."""

    __slots__ = ("article", "bad", "box", "link", "number", "remark", "tag", "trail", "up")

    def __init__(self, tag: str, up: _Node | None, bad: bool, number: int, remark: bool = False, trail: int = 0):
        self.tag, self.up, self.bad, self.number, self.trail = tag, up, bad, number, trail
        self.remark = remark
        self.article = tag in ("article", "main") and not remark or up is not None and up.article and not remark
        self.link = tag == "a" or up is not None and up.link and tag not in BLOCKS
        self.box = self if up is None or tag in BLOCKS else up.box

    @property
    def path(self) -> tuple:
        x, tags = self, []
        while x is not None:
            tags.append(x.tag)
            x = x.up
        return tuple(reversed(tags))


class _Reader:
    """Leaves of a page in one pass. Paths are numbered (`trails`: the number of the path above each), and the open elements
    that a tag could close are kept at hand, so work grows with the page and not with how deep it is nested."""

    def __init__(self, page: str):
        self.root = _Node("", None, False, 0)
        self.nodes, self.trails = [self.root], [0]
        self.leaves: list[tuple[_Node, int, str]] = []
        self._stack, self._open, self._known = [self.root], Counter(), {}
        self._kinds, self._bounds = [[] for _ in CLOSERS], [[] for _ in CLOSERS]
        self._read(page)

    def _enter(self, tag: str, attrs: str) -> None:
        up, depth = self._stack[-1], len(self._stack)
        bad, remark = (True, False) if up.bad else _judged(tag, attrs, self._open["article"] > 0)
        at = (up.trail, tag, remark)
        trail = self._known.get(at)
        if trail is None:
            trail = self._known[at] = len(self.trails)
            self.trails.append(up.trail)
        node = _Node(tag, up, bad, len(self.nodes), remark, trail)
        self.nodes.append(node)
        self._stack.append(node)
        self._open[tag] += 1
        for i in _KINDS.get(tag, ()):
            self._kinds[i].append(depth)
        for i in _BOUNDS.get(tag, ()):
            self._bounds[i].append(depth)

    def _leave(self, depth: int) -> None:
        """Closes the open elements from `depth` on."""
        while len(self._stack) > depth:
            tag = self._stack.pop().tag
            self._open[tag] -= 1
            for i in _KINDS.get(tag, ()):
                self._kinds[i].pop()
            for i in _BOUNDS.get(tag, ()):
                self._bounds[i].pop()

    def _close_for(self, tag: str) -> None:
        for i in _CLOSES.get(tag, ()):
            kinds, bound = self._kinds[i], self._bounds[i][-1] if self._bounds[i] else 0
            if not kinds or kinds[-1] <= bound:
                continue
            depth = kinds[-1]
            if tag == "tr":  # the whole row, not its last cell
                k = len(kinds)
                while k and kinds[k - 1] > bound:
                    k -= 1
                depth = kinds[k]
            self._leave(depth)

    def _read(self, page: str) -> None:
        at, block, size = 0, 0, len(page)
        stack = self._stack
        while at < size:
            m = _TOKEN.search(page, at)
            end = m.start() if m else size
            if end > at and not stack[-1].bad:
                self.leaves.append((stack[-1], block, html.unescape(page[at:end])))
            if not m:
                break
            at = max(m.end(), at + 1)
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if tag == "br":
                if not stack[-1].bad:
                    self.leaves.append((stack[-1], block, " "))
                continue
            if m[1]:  # an end tag closes up to its element, if that is open
                if self._open[tag]:
                    depth = len(stack) - 1
                    while stack[depth].tag != tag:
                        depth -= 1
                    self._leave(depth)
                block += tag in BLOCKS
                continue
            self._close_for(tag)
            block += tag in BLOCKS
            if tag in VOID or m[3].rstrip().endswith("/") and tag not in BLOCKS:
                continue
            if tag in RAW:
                close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else size
                continue
            self._enter(tag, m[3])


def leaves(page: str) -> list[tuple[_Node, int, str]]:
    """(element, block number, decoded text) of each text node outside vetoed elements, in page order."""
    return _Reader(page).leaves


def _size(text: str) -> tuple[int, int]:
    """Characters but for spaces, and marks of punctuation."""
    return len(text) - text.count(" "), len(_PUNCTUATION.findall(text))


def trail_scores(sums: dict[int, list[int]], above: list[int]) -> dict[int, float]:
    """Fused score of each path number of `sums` (elements, characters, marks); above[n] is the path one tag shorter, 0 the root.

    The geometric mean of smoothed characters and punctuation an element. The weight of a path for
    another falls with their distance, the tags to take off and put on to get from one to the other. Sums by
    depth below each beginning give all paths at a distance at once, as far as REACH, so work grows with
    the number of paths and neither with its square nor with their depth.
    """
    chains = {}
    for p in sums:
        chain = [p]
        while chain[-1] and len(chain) <= REACH:
            chain.append(above[chain[-1]])
        chains[p] = chain
    below = {}  # (beginning, tags further down): sums over the paths there
    for p, chain in chains.items():
        for k, number in enumerate(chain):
            s = below.setdefault((number, k), [0, 0, 0])
            for i in range(3):
                s[i] += sums[p][i]
    out = {}
    for p, chain in chains.items():
        weight = length = marks = 0.0
        for up, number in enumerate(chain):
            for down in range(REACH + 1 - up):
                s = below.get((number, down))
                if s is None:
                    continue
                own = below.get((chain[up - 1], down - 1), (0, 0, 0)) if up and down else (0, 0, 0)  # met from a longer beginning
                w = _WEIGHTS[up + down]
                weight += w * (s[0] - own[0])
                length += w * (s[1] - own[1])
                marks += w * (s[2] - own[2])
        out[p] = math.sqrt(length / weight * (marks / weight + 0.1))
    return out


def path_scores(texts: Iterable[tuple[_Node, int, str]]) -> dict[tuple, float]:
    """trail_scores by path, a tuple of tags, of (element, block, text); texts without a character count for nothing."""
    known, above, sums, names = {}, [0], {}, {}
    for node, _, text in texts:
        n, marks = _size(text)
        if not n:
            continue
        at = 0
        for tag in node.path:
            if (at, tag) not in known:
                known[at, tag] = len(above)
                above.append(at)
            at = known[at, tag]
        names[at] = node.path
        s = sums.setdefault(at, [0, 0, 0])
        for i, x in enumerate((1, n, marks)):
            s[i] += x
    return {names[p]: score for p, score in trail_scores(sums, above).items()}


def fused(sums: dict[int, list[int]], above: list[int]) -> dict[int, float]:
    """What a path's texts speak for it: trail_scores up to FULL, and its share of the page's characters, to the power of SHARE."""
    most = max(n for _, n, _ in sums.values())
    return {p: min(score, FULL) * (sums[p][1] / most) ** SHARE for p, score in trail_scores(sums, above).items()}


class _Block:
    """Leaves of one block: its element, characters in all and in links, number of links, score times characters."""

    __slots__ = ("box", "linked", "links", "mass", "parts", "size")

    def __init__(self, box: _Node):
        self.box, self.parts, self.size, self.linked, self.links, self.mass = box, [], 0, 0, 0, 0.0


def _beside(read: _Reader, own: dict[int, list[int]]) -> list[int]:
    """How many elements of comments, and forms that do not wrap most of the page, each element lies in."""
    size = [0] * len(read.nodes)
    for number, (_, n, _) in own.items():
        size[number] = n
    for k in range(len(size) - 1, 0, -1):  # elements come after those that hold them
        size[read.nodes[k].up.number] += size[k]
    out = [0] * len(size)
    for k in range(1, len(size)):
        node = read.nodes[k]
        out[k] = out[node.up.number] + (node.remark or node.tag == "form" and size[k] < HELD * size[0])
    return out


def _blocks(read: _Reader) -> tuple[list[_Block], list[int]]:
    """The page's blocks that have text, scored: paths weigh by their ratios, and by article, comments and forms; and _beside."""
    own, sums, total = {}, {}, 0
    for node, _, text in read.leaves:  # an element counts once, however often others interrupt its text
        n, marks = _size(text)
        if n:
            s = own.setdefault(node.number, [0, 0, 0])
            s[1] += n
            s[2] += marks
            total += n
    for number, (_, n, marks) in own.items():
        s = sums.setdefault(read.nodes[number].trail, [0, 0, 0])
        for i, x in enumerate((1, n, marks)):
            s[i] += x
    if not sums:
        return [], []
    beside = _beside(read, own)
    scores = fused(sums, read.trails)
    article = ARTICLE * TAGS ** (CHARS / (CHARS + total))
    out, now, last = [], None, None
    for node, block, text in read.leaves:
        n = len(text) - text.count(" ")
        if block != now:
            out.append(_Block(node.box))
            now = block
        b = out[-1]
        b.parts.append(text)
        if n:
            b.size += n
            b.mass += n * scores[node.trail] * (article if node.article else 1) * REMARK ** min(beside[node.number], 3)
            if node.link:
                b.linked += n
                b.links += node is not last
                last = node
    return [b for b in out if b.size], beside


def main_text(page: str | None) -> str:
    """The article's blocks joined by blank lines; character references decoded, white space in a block made one space."""
    read = _Reader(page or "")
    blocks, beside = _blocks(read)
    if not blocks:
        return ""
    least = THRESHOLD * max(b.mass / b.size for b in blocks)
    nodes = read.nodes
    count = len(nodes)
    content, size, linked, links = ([0] * count for _ in range(4))
    formed, flows = [False] * count, [False] * count  # flows: where content stands as running text
    for b in blocks:
        k = b.box.number
        size[k] += b.size
        linked[k] += b.linked
        links[k] += b.links
        formed[k] |= b.box.tag in SHORT_FLOW
        if b.mass >= least * b.size:
            content[k] += b.size
            flows[k] = True
    for k in range(count - 1, 0, -1):  # elements come after those that hold them
        up = nodes[k].up.number
        size[up] += size[k]
        linked[up] += linked[k]
        links[up] += links[k]
        content[up] += content[k]
        formed[up] |= formed[k]
        flows[up] |= flows[k] and (nodes[k].tag in FLOW or nodes[k].tag not in BLOCKS)
    barren = list(range(count))  # the largest element without content around each one without
    for k in range(1, count):
        up = nodes[k].up.number
        if not content[k] and not content[up]:
            barren[k] = barren[up]
    held = HELD * content[0]

    def stays(b: _Block) -> bool:
        if b.mass >= least * b.size:
            return True
        k = b.box.number
        if content[k]:  # loose text between blocks of content
            return beside[k] == 0 and not (b.links > 1 and b.linked >= LINKS * b.size)
        top = nodes[barren[k]]
        around, k = top.up, top.number
        if around is None or beside[b.box.number] > beside[around.number]:
            return False
        if top.tag in HEADINGS and (around.article or flows[around.number] or content[around.number] >= held):
            return True
        if links[k] > 1 and linked[k] >= LINKS * size[k]:
            return False
        if top.tag in FLOW or top.tag not in BLOCKS:
            return around.article or flows[around.number]
        return around.article and formed[k]

    found = (" ".join("".join(b.parts).split()) for b in blocks if stays(b))
    return "\n\n".join(x for x in found if x)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row, from the whole html, without a shuffle.

    Null or empty html, or none with text in it, gives an empty text. Broken and unclosed markup is read
    like a browser does in the main: end tags close what they can, a new paragraph ends the last. Nesting of
    any depth and any number of paths take time in proportion to the page. Repeated rows agree; a null id or
    url stays; extra columns of any name are ignored; no rows give none.
    """

    def rows(b: pa.RecordBatch) -> dict:
        texts = [main_text(h) for h in b.column("html").to_pylist()]
        return {"page_id": b.column("page_id"), "url": b.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    return arrow_map(picked(pages, page_id=id_col, url=url_col, html=html_col), rows, "page_id long, url string, text string, n_chars long")
