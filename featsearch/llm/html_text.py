"""HTML extraction by composite text density.

The page is read into a DOM of block elements. Every node gets its characters
C, link characters L, tags T and link tags K (itself included), and from them
a link-adjusted density

    CTD = C / T * log(C T / (L K)) base ln(C L / (C - L) + L_body C / C_body + e)

with L and K at least 1. A node's sum is the sum of its children's densities
(text that stands directly in it is a child with the node's own density). The
subtree with the largest sum is the core; the least density on its path to the
body is the threshold, and other subtrees that reach it are content as well.
The text is that of the ``article`` or ``main`` element around the core, and of
other such elements that are content; without one, that of the smallest subtree
that holds all content, less the subtrees below the threshold that are mostly
links.

Elements that never belong to an article (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments; by tag, role, and
words of class or id) take no part and are left out of the text. Layout wrappers
that are named after such an element stay: tokens like ``has-sidebar`` or
``content-sidebar-wrap`` are not its name, and an element dropped for a word (of
reader comments excepted) stays if it holds ``main``, or most of the page's text
outside links and either an ``article``, an ``h1`` or only longer names; so does
a ``form`` around the page. A ``header`` inside an article stays if it holds the
heading. A paragraph, heading, list item, cell or inline element goes only for a
class or id that is such a name, not for a word in a longer one.

Defined results: null, empty and textless pages give an empty text; markup
that never closes runs to the end of the page; white space inside a block
becomes one space, blocks are joined by one space; null ids and repeated rows
are treated like any other; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featsearch.llm.common import python_ready

# Possessive quantifiers: an unclosed tag or quote fails at once.
MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))"
    r"|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|</(?P<end>[A-Za-z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|<(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

#: Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr img".split()
)
DROPPED = frozenset(
    "head script style noscript template iframe object embed svg math canvas audio video nav header footer aside "
    "form button input select option textarea dialog menu map noembed noframes xmp title fieldset datalist".split()
)
DROPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split()
)
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar "
    "navigation menu menubar breadcrumb breadcrumbs sidebar side aside footer header masthead topbar cookie cookies "
    "consent gdpr notice notices notification alert popup modal newsletter subscribe signup login comment comments "
    "disqus reply replies share sharing social related recommended pagination pager toolbar widget skip".split()
)
COMMENT_WORDS = frozenset("comment comments disqus reply replies".split())
#: Parts of a token that says what a wrapper has or lacks, and that names a wrapper of the content.
LAYOUT_WORDS = frozenset("has have no non not with without".split())
WRAP_WORDS = frozenset("wrap wrapper container layout".split())
CONTENT_WORDS = frozenset("content article".split())
#: Why an element is dropped: its nature, a word in a longer name, its name, reader
#: comments, a tag that may also hold the article or its heading.
HARD, PART, NAME, COMMENT, SOFT = 1, 2, 3, 4, 5
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption".split())
_P_CLOSERS = frozenset(
    "address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: A start tag closes an open element of these names, unless a boundary is met.
_CLOSES = {
    **{t: ({"p"}, set()) for t in _P_CLOSERS},
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_SCOPES = frozenset("table td th caption button object html body template article section div".split())


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "runs", "chars", "link_chars", "tags", "link_tags", "density", "sum", "open", "why")

    def __init__(self, tag, parent, why):
        self.tag, self.parent, self.why, self.children, self.runs = tag, parent, why, [], []
        self.dropped = False
        self.chars = self.link_chars = self.link_tags = 0
        self.tags = 1
        self.density = self.sum = 0.0
        self.open = True


def _named(value: str) -> int:
    """Why a class or id is furniture; 0 if no token of it names any."""
    why = 0
    for token in value.split():
        parts = set(re.split(r"[^a-z0-9]+", token)) - {""}
        words = parts & DROPPED_WORDS
        if not words or parts & LAYOUT_WORDS or parts & WRAP_WORDS and parts & CONTENT_WORDS:
            continue
        why = max(why, COMMENT if words & COMMENT_WORDS else NAME if words == parts else PART)
    return why


def _why(tag: str, attrs: str) -> int:
    if tag in ("form", "header"):
        return SOFT
    if tag in DROPPED:
        return HARD
    if not attrs or tag in ("html", "body", "article", "main"):
        return 0
    why = 0
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            why = max(why, _named(value))
        if name == "role" and value in DROPPED_ROLES:
            return HARD
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return HARD
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return HARD
    return 0 if why == PART and (tag in INLINE or tag in TEXT_BLOCKS) else why


def _drop(root: Node) -> None:
    """Mark the dropped nodes; wrappers that hold the page's content are not."""
    order = _preorder(root)
    text, has = {}, {}  # characters outside links, and tags that mark content
    for n in reversed(order):
        if n.why == HARD:
            text[id(n)], has[id(n)] = 0, set()
            continue
        text[id(n)] = n.chars - n.link_chars + sum(text[id(c)] for c in n.children if c.tag != "header" or not c.why)
        has[id(n)] = set().union(*(has[id(c)] for c in n.children if has[id(c)]))
        if n.tag in ("main", "article", "h1"):
            has[id(n)].add(n.tag)
    inside = set()  # nodes of an article
    for n in order:
        if n.tag in ("main", "article") or n.parent is not None and id(n.parent) in inside:
            inside.add(id(n))
        most = 2 * text[id(n)] > text[id(root)]
        holds = "main" in has[id(n)] or most and (n.why in (PART, SOFT) or bool(has[id(n)]))
        if n.tag == "header":
            holds = id(n) in inside and "h1" in has[id(n)]
        stays = not n.why or n.why in (PART, NAME, SOFT) and holds
        n.dropped = not stays or n.parent is not None and n.parent.dropped


def parse(page: str) -> Node:
    """The block elements of a page; a run is text between block boundaries."""
    root = node = Node("#page", None, 0)
    open_inline: list[list] = []  # inline elements: tag, node, whether they hide their text, whether open
    by_tag: dict[str, list] = {}  # the open ones of a tag, so an end tag searches for nothing
    hidden = 0
    is_open: Counter = Counter()  # open elements by name: what is not open is not searched for
    buffer: list[str] = []
    link_chars = at = 0

    def flush():
        nonlocal link_chars
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            node.runs.append((len(node.children), text))
            node.chars += len(text)
            node.link_chars += min(link_chars, len(text))
        link_chars = 0

    def add(text):
        nonlocal link_chars
        if hidden:
            return
        buffer.append(text)
        if is_open["a"]:
            link_chars += len(text.strip())

    def end_inline(tag):
        nonlocal hidden
        ended = by_tag[tag].pop()
        ended[3] = False
        is_open[tag] -= 1
        hidden -= ended[2]

    def close(to):
        """Leave ``node`` up to and including ``to``, with the inline elements in it."""
        nonlocal node
        flush()
        while True:
            node.open = False
            is_open[node.tag] -= 1
            left, node = node, node.parent
            if left is to:
                break
        while open_inline and not (open_inline[-1][3] and open_inline[-1][1].open):
            if open_inline[-1][3]:
                end_inline(open_inline[-1][0])
            open_inline.pop()

    while at < len(page):
        m = MARKUP.search(page, at)
        if m is None:
            add(html.unescape(page[at:]))
            break
        if m.start() > at:
            add(html.unescape(page[at : m.start()]))
        at = m.end()
        if m["cdata"] is not None:
            add(m["cdata"])
        elif m["end"]:
            tag = m["end"].lower()
            if tag == "br":
                flush()
            elif tag in INLINE:
                if is_open[tag]:
                    end_inline(tag)
            elif is_open[tag]:
                up = node
                while up.tag != tag:
                    up = up.parent
                close(up)
            else:
                flush()
        elif m["tag"]:
            tag, attrs = m["tag"].lower(), m["attrs"]
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
                node.tags += 1
                if tag not in INLINE:
                    flush()
            elif tag in VOID:
                node.tags += 1
                if tag not in INLINE:
                    flush()
            elif tag in INLINE:
                node.tags += 1
                node.link_tags += tag == "a"
                open_inline.append([tag, node, _why(tag, attrs) > 0, True])
                by_tag.setdefault(tag, []).append(open_inline[-1])
                is_open[tag] += 1
                hidden += open_inline[-1][2]
            else:
                closing, stop = _CLOSES.get(tag, ((), ()))
                up = node
                while up is not root and any(is_open[c] for c in closing):
                    if up.tag in closing:
                        close(up)
                        break
                    if up.tag in (stop or _SCOPES):
                        break
                    up = up.parent
                flush()
                child = Node(tag, node, _why(tag, attrs))
                node.children.append(child)
                is_open[tag] += 1
                node = child
    flush()
    _drop(root)
    return root


def _preorder(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.children))
    return out


def _measure(order: list[Node]) -> None:
    """Densities and sums, children before parents; dropped nodes have none."""
    own = {id(n): n.chars for n in order}
    for n in reversed(order):
        if not n.dropped and n.parent is not None:
            p = n.parent
            p.chars, p.link_chars = p.chars + n.chars, p.link_chars + n.link_chars
            p.tags, p.link_tags = p.tags + n.tags, p.link_tags + n.link_tags
    body = order[0]
    share = body.link_chars / body.chars if body.chars else 0.0
    for n in order:
        if n.dropped or not n.chars:
            continue
        c, k, t = n.chars, max(1, n.link_tags), n.tags
        links = max(1, n.link_chars)
        base = math.log(c * n.link_chars / max(1, c - n.link_chars) + share * c + math.e)
        n.density = c / t * max(0.0, math.log(max(1.0, c * t / (links * k))) / base)
    for n in order:
        if own[id(n)] and not n.dropped:
            n.sum += n.density
        if n.parent is not None:
            n.parent.sum += n.density


def articles(root: Node) -> list[Node]:
    """The subtrees that hold the main text, in page order, by composite text
    density."""
    order = [n for n in _preorder(root) if not n.dropped]
    _measure(order)
    core = max((n for n in order if n.chars), key=lambda n: n.sum, default=None)
    if core is None:
        return []
    path = []
    up = core
    while up is not None:
        path.append(up)
        up = up.parent
    threshold = min(n.density for n in path)
    for tag in ("article", "main"):
        around = [n for n in path if n.tag == tag]
        if around:
            outer = {id(n) for n in around}
            found, covered = [], set()
            for n in order:
                if n.parent is not None and id(n.parent) in covered:
                    covered.add(id(n))
                elif n is around[-1] or n.tag == tag and id(n) not in outer and n.density >= threshold:
                    found.append(n)
                    covered.add(id(n))
            return found
    content, stack = [core], [root]
    while stack:
        n = stack.pop()
        if n.dropped or n.density < threshold:
            continue
        if not n.children or n is core:
            content.append(n)
        else:
            stack.extend(n.children)
    shared = set(map(id, path))
    for n in content:
        ups = set()
        while n is not None:
            ups.add(id(n))
            n = n.parent
        shared &= ups
    whole = next(n for n in path if id(n) in shared)
    on_path = set(map(id, path))
    for n in _preorder(whole):
        if id(n) not in on_path and n.density < threshold and 2 * n.link_chars > n.chars:
            n.dropped = True
    return [whole]


def text_of(node: Node) -> str:
    blocks: list[str] = []
    stack: list = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            blocks.append(n)
            continue
        if n.dropped:
            continue
        parts: list = []
        runs = iter([*n.runs, (len(n.children) + 1, "")])
        before, text = next(runs)
        for i, child in enumerate([*n.children, None]):
            while before <= i:
                parts.append(text)
                before, text = next(runs)
            if child is not None:
                parts.append(child)
        stack.extend(reversed(parts))
    return " ".join(blocks)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return " ".join(filter(None, map(text_of, articles(parse(page)))))


def extract(pages: DataFrame, id_col="page_id", html_col="html", carry=("url",)) -> DataFrame:
    """``id``, the columns of ``carry`` and ``text``, the main text of the page."""

    @F.arrow_udf("string")
    def pull(texts: pa.Array) -> pa.Array:
        return pa.array([main_text(t) for t in texts.to_pylist()], pa.string())

    python_ready(pages.sparkSession)
    rows = pages.select(
        F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{c}`") for c in carry], F.col(f"`{html_col}`").cast("string").alias("__page")
    )
    return rows.select("id", *[F.col(f"`{c}`") for c in carry], pull.asNondeterministic()("__page").alias("text"))
