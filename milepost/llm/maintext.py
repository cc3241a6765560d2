"""Main text of web pages by composite text density.

Per page a small tree is built from the markup. Every node gets its link-adjusted
characters per tag (composite text density), every node the sum of its children's
densities. The subtree with the largest sum is the seed; the lowest density on the path
from it up to the body is the threshold, and inside every node that reaches the threshold
the subtree with the largest sum is content too. Formatting (bold, line breaks, spans) is
no node of its own: its text is the block's. The tags ``article`` and ``main`` count as any
other block.

Elements that say they are no main text (menus, headers, footers, asides, forms, adverts,
notices, comments, by tag, role, class or id) are marked. In a first choice of the seed
over the whole page their characters count less; marked elements that hold this seed or
most of its text stay, the others are left out, and the choice is made again without them.

Pages are independent: no shuffle, one page in memory at a time.

Defined results: null or empty html and pages without text give an empty text; broken or
unclosed markup is closed where the next block starts (an unclosed script, style, xmp or
textarea holds the rest of the page); character references are decoded
(unknown ones stay); repeated rows are treated each by itself; an empty table gives an
empty result. Only page_id, url and html are read, so other columns can't clash.
"""

from __future__ import annotations

import html as _html
import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship_package
from .arrays import pieces

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME = re.compile(r"[a-z]+")

# Elements of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg object xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p "
    "pre search section summary table tbody td tfoot th thead tr ul caption".split())
INLINE = frozenset(
    "abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rb rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover "
    "mtable mtr mtd mstyle mspace semantics".split())
TO_END = frozenset("script style textarea xmp".split())  # unclosed they hold the rest
SUSPECT = frozenset(
    "head nav footer aside form button select option input label menu dialog canvas audio video "
    "map datalist fieldset".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
             "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"},
          "th": {"table"}, "option": {"select"}}
# Words of a class, id or role that mark what is no main text.
MARKERS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs "
    "comment comments complementary consent contentinfo cookie cookies copyright disclaimer "
    "disqus footer gdpr header login masthead menu modal nav navbar navigation navigate "
    "newsletter notice notices notification overlay pager pagination popup promo promoted "
    "promotion recommended related replies reply respond search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription toolbar topbar warning widget alert "
    "aside toc tags".split())
# In the first choice a character counts MARK_WEIGHT times less for each mark around it, up to MARKS.
MARK_WEIGHT, MARKS = 5, 2

_NEXT_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK))}|body|html)(?=[\s/>])", re.I)


@lru_cache(maxsize=None)
def _raw_tags(name: str) -> re.Pattern:
    return re.compile(rf"<!--.*?-->|<(?P<end>/?){name}(?=[\s/>])(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>", re.I | re.S)


@lru_cache(maxsize=4096)
def _marked(attrs: str, inside: bool) -> bool:
    """Whether the attributes say that this is no main text; inside an article its header is."""
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
        elif not MARKERS.isdisjoint(w for w in _NAME.findall(value) if not (inside and w == "header")):
            return True
    return False


class Page:
    """Nodes in page order with parents, and the texts and block ends in page order."""

    def __init__(self, source: str):
        self.tag, self.parent, self.out, self.marked = ["body"], [-1], [False], [False]
        self._source, self._closings = source, {}
        self.events: list[tuple[int, str | None]] = []
        self._stack = [0]
        self._depths: dict[str, list[int]] = {}   # places of the open elements of a name on the stack
        self._blocks: list[int] = []              # and of the open blocks
        self._inside = [False]                    # in an article or main, by node
        pos, end = 0, len(source)
        while pos < end:
            m = _TAG.search(source, pos)
            if m is None:
                break
            if m.start() > pos:
                self.events.append((self._stack[-1], source[pos:m.start()]))
            pos = m.end()
            name = (m["name"] or m["name2"] or "").lower()
            if not name:
                continue
            if m["end"] or m["end2"]:
                self._close(name)
                continue
            attrs = m["attrs"] or m["attrs2"] or ""
            self._open(name, attrs)
            if name in RAW:
                if not attrs.rstrip().endswith("/"):
                    pos = self._raw_end(name, m.start(), pos)
                self._close(name)
        if pos < end:
            self.events.append((self._stack[-1], source[pos:]))

    def _raw_end(self, name: str, start: int, pos: int) -> int:
        """Where the raw element that opened at ``start`` ends; it is unclosed before the next block."""
        if name in TO_END:
            closing = re.compile(rf"</{name}\s*>", re.I).search(self._source, pos)
            return closing.end() if closing else len(self._source)
        if name not in self._closings:
            closings, opened = {}, []
            for m in _raw_tags(name).finditer(self._source):
                if m["end"]:
                    if opened:
                        closings[opened.pop()] = m.end()
                elif m["end"] is not None and m[0][-2] != "/":
                    opened.append(m.start())
            self._closings[name] = closings
        if start in self._closings[name]:
            return self._closings[name][start]
        block = _NEXT_BLOCK.search(self._source, pos)
        return block.start() if block else len(self._source)

    def _break(self) -> None:
        self.events.append((self._stack[-1], None))

    def _pop_to(self, depth: int) -> None:
        """Close all elements from ``depth`` on; each element is closed once."""
        for node in reversed(self._stack[depth:]):
            self._depths[self.tag[node]].pop()
            if self.tag[node] in BLOCK:
                self._blocks.pop()
        del self._stack[depth:]

    def _last(self, names) -> int:
        """Place of the innermost open element of these names, 0 if there is none."""
        return max((self._depths[n][-1] for n in names if self._depths.get(n)), default=0)

    def _open(self, name: str, attrs: str) -> None:
        if name in ("html", "body"):
            if name == "body":
                self._close("head")
            return
        stack = self._stack
        if name in BLOCK:  # an open paragraph ends where a block starts
            p = self._last(("p",))
            if p and p >= (self._blocks[-1] if self._blocks else 0):
                self._pop_to(p)
        if name in CLOSED_BY:
            open_ = self._last(CLOSED_BY[name])
            if open_ > self._last(SCOPES[name]):
                self._pop_to(open_)
        if name in BLOCK or name == "br":
            self._break()
        inside = self._inside[stack[-1]]
        self._inside.append(inside or name in ("article", "main"))
        self.tag.append(name)
        self.parent.append(stack[-1])
        self.out.append(name in RAW or self.out[stack[-1]])
        self.marked.append(name in SUSPECT or name == "header" and not inside
                           or name not in ("article", "main") and _marked(attrs, inside))
        if name not in VOID:
            self._depths.setdefault(name, []).append(len(stack))
            if name in BLOCK:
                self._blocks.append(len(stack))
            stack.append(len(self.tag) - 1)

    def _close(self, name: str) -> None:
        depth = self._last((name,))
        if not depth or name not in BLOCK and self._blocks and depth < self._blocks[-1]:
            return  # nothing to close, or an inline end tag behind an open block
        self._pop_to(depth)
        if name in BLOCK:
            self._break()


def _densities(page: Page, texts: list[int]):
    """Characters, densities and density sums of every node."""
    n = len(page.tag)
    chars, tags, link_chars, link_tags = list(texts), [0] * n, [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        if page.out[i]:
            continue
        p, link = page.parent[i], page.tag[i] == "a"
        chars[p] += chars[i]
        tags[p] += tags[i] + (page.tag[i] not in INLINE)
        link_chars[p] += chars[i] if link else link_chars[i]
        link_tags[p] += link_tags[i] + link
        if link:
            link_chars[i] = chars[i]
    body = link_chars[0] / max(1, chars[0])
    density, total = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        c, t, lc, lt = chars[i], max(1, tags[i]), max(1, link_chars[i]), max(1, link_tags[i])
        inline = page.tag[i] in INLINE
        if c and not inline and not page.out[i]:
            base = math.log(c / max(1, c - link_chars[i]) * link_chars[i] + body * c + math.e)
            density[i] = c / t * max(0.0, math.log(c / lc * t / lt)) / max(0.1, math.log(base))
        if i and not page.out[i]:
            total[page.parent[i]] += total[i] if inline else density[i]
    return chars, link_chars, density, total


def _leave_out_marked(page: Page, own: list[int]) -> None:
    """Marks as out what is marked, but not the elements that hold the seed of the first choice."""
    n = len(page.tag)
    marks, weighted = [0] * n, list(own)
    for i in range(n):
        if i:
            marks[i] = min(MARKS, marks[page.parent[i]] + page.marked[i])
        weighted[i] *= MARK_WEIGHT ** (MARKS - marks[i])
    chars, link_chars, _, total = _densities(page, weighted)
    seed = max((i for i in range(n) if page.tag[i] not in INLINE), key=total.__getitem__)
    holding, i = set(), seed
    while i >= 0:
        holding.add(i)
        i = page.parent[i]
    for i in range(seed + 1, n):  # down to the child with more than half of the text
        p = page.parent[i]
        if p == seed and 2 * (chars[i] - link_chars[i]) > chars[p] - link_chars[p]:
            holding.add(i)
            seed = i
    for i in range(1, n):
        page.out[i] = page.out[i] or page.out[page.parent[i]] or page.marked[i] and i not in holding


def main_text(source: str) -> str:
    """The main text of one page."""
    page = Page(source)
    n = len(page.tag)
    own = [0] * n
    events = []
    for node, text in page.events:
        if text is None:
            events.append((node, None))
        elif not page.out[node]:
            text = _html.unescape(text)
            own[node] += len("".join(text.split()))
            events.append((node, text))
    if any(page.marked):
        _leave_out_marked(page, own)
        own = [0 if out else c for out, c in zip(page.out, own)]
    for i in range(n - 1, 0, -1):  # formatted text is its block's
        if page.tag[i] in INLINE:
            own[page.parent[i]] += own[i]
            own[i] = 0
    chars, link_chars, density, total = _densities(page, own)
    if not chars[0]:
        return ""
    # the largest density sum inside each subtree
    best = list(range(n))
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        if page.out[i] or page.tag[best[i]] in INLINE:
            continue
        if page.tag[best[p]] in INLINE or total[best[i]] > total[best[p]]:
            best[p] = best[i]
    seed = best[0] if total[best[0]] > 0 else 0
    path, i = set(), seed
    while i >= 0:
        path.add(i)
        i = page.parent[i]
    threshold = min(density[i] for i in path if page.tag[i] not in INLINE)
    content, reached = [False] * n, [False] * n
    content[seed] = True
    for i in range(n):
        p, inline = page.parent[i], page.tag[i] in INLINE
        reached[i] = not page.out[i] and (inline or density[i] >= threshold) and (p < 0 or reached[p])
        if reached[i] and not inline:
            if total[best[i]] > 0:
                content[best[i]] = True
            elif density[i] > 0 and own[i]:
                content[i] = True
        if re.fullmatch("h[1-6]", page.tag[i]) and p in path:
            content[i] = True
    for i in range(1, n):
        content[i] = (content[i] or content[page.parent[i]]) and not page.out[i]
        # lists and boxes of links inside the content are menus
        if content[i] and page.tag[i] in ("ul", "ol", "div", "section", "table", "dl") \
                and chars[i] and link_chars[i] > 0.6 * chars[i]:
            content[i], page.out[i] = False, True
    blocks, current = [], []
    for node, text in [*events, (0, None)]:
        if text is None:
            block = " ".join("".join(current).split())
            if block:
                blocks.append(block)
            current = []
        elif content[node]:
            current.append(text)
    return " ".join(blocks)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page."""
    ship_package(pages.sparkSession)

    def run(batches):
        for piece in pieces(batches, "html"):
            texts = [main_text(x or "") for x in piece.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(texts, pa.string())],
                                             names=["page_id", "url", "text"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def op9_text_density(spark, sf_dir: str) -> DataFrame:
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.selectExpr("page_id", "url", "text", "cast(char_length(text) as bigint) as n_chars")
