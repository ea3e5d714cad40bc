"""Main text of HTML pages by composite text density.

First, elements that are no article text by their kind (scripts, menus, forms, ...) or by what they say of themselves (class,
id, role, hidden) are cut off. The nodes of the tree are then blocks and links; marks inside a line (b, em, br, span, ...)
are part of the text of the block they stand in. For every node: C characters, T tags, LC characters in links, LT link tags
below it. With the body's C_b and LC_b its composite density is

    C/T * log(C/LC * T/LT) / log(ln(C * LC / (C - LC) + C * LC_b / C_b + e))          (denominators of 0 count as 1)

and its density sum is the sum over its children. The node with the largest sum is the core; the least density on the path
from the body to it is the threshold, and every other node at or over it adds the largest-sum subtree below it. A level-one
heading is added where none is in these. No element is chosen for its name. Then blocks are read in page order.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

SCHEMA = "page_id bigint, url string, text string, n_chars bigint"

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table caption colgroup tbody td tfoot th thead tr ul".split()
)
#: Start tags before which an open p ends.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: An element of the first kind ends an open one of the second kinds, up to the nearest of the third.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "optgroup"}),
}
SCOPE = frozenset("html body table td th caption article section main div aside nav footer header form button".split())
NOT_TEXT = frozenset("script style noscript template iframe object embed applet svg math canvas audio video map head title nav menu header footer aside form button select textarea input dialog datalist progress meter noembed noframes".split())
#: What class, id or role say of an element that is not part of the article.
HINTS = frozenset(
    "ad ads adbox adslot adsense adsbygoogle advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion promoted commercial comment comments commentlist commenting disqus discussion respond reply replies feedback reviews nav navbar navigation navi menu menus submenu topnav breadcrumb breadcrumbs sidebar sidebars aside rail footer foot colophon header masthead topbar banner cookie cookies consent gdpr ccpa privacy notice notices notification notifications alert alerts popup modal overlay lightbox interstitial newsletter subscribe subscription signup login signin register paywall share sharing sharebar social socials related recommended recommendations readmore trending popular widget widgets toolbar pagination pager tagcloud search searchbox searchform copyright disclaimer legal complementary contentinfo skip hidden visuallyhidden toc outbrain taboola".split()
)
#: Of these, the ones that say so even of a box that holds article elements (a comment is often one).
REMARKS = frozenset("comment comments commentlist commenting disqus discussion respond replies reviews related recommended recommendations".split())
KEEP_WHOLE = frozenset(("html", "body"))
#: Marks inside a line: part of the block around them, no nodes of their own.
INLINE = frozenset("abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$|["'])""", re.I)
_TOKENS = re.compile(r"[a-z0-9]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("blocks", "chars", "children", "cut", "density", "hint", "lchars", "ltags", "name", "parent", "sum", "tags")

    def __init__(self, name: str, parent: Node | None):
        self.name, self.parent = name, parent
        self.children: list = []  # nodes and strings, in page order
        self.blocks: list[Node] = []  # child nodes, through marks inside a line
        self.cut, self.hint = False, 0
        self.chars = self.tags = self.lchars = self.ltags = 0
        self.density = self.sum = 0.0


def _own_words(rest: str) -> tuple[bool, int]:
    """(hidden, hinted: 0 no, 1 yes, 2 as a remark) of a start tag's attributes."""
    hidden, hinted = False, 0
    for m in _ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden":
            hidden = True
        elif key == "aria-hidden":
            hidden |= value.lower() == "true"
        elif key == "style":
            hidden |= bool(_UNSEEN.search(value))
        else:
            tokens = _TOKENS.findall(re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", value).lower())
            hinted = max(hinted, 0 if HINTS.isdisjoint(tokens) else 1 if REMARKS.isdisjoint(tokens) else 2)
    return hidden, hinted


def parse(page: str) -> Node:
    """A tree from any text: unclosed, crossed and stray tags are mended as browsers mostly do."""
    root = Node("html", None)
    stack = [root]
    at, end = 0, len(page)

    there = Counter({"html": 1})  # names on the stack: what is not open is not looked for

    def close_to(depth: int) -> None:
        there.subtract(n.name for n in stack[depth:])
        del stack[depth:]

    def opened(node: Node) -> None:
        stack.append(node)
        there[node.name] += 1

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            stack[-1].children.append(_html.unescape(page[at:]))
            break
        m = _MARKUP.match(page, lt)
        if m is None:  # a "<" that starts no markup is text
            stack[-1].children.append(_html.unescape(page[at : lt + 1]))
            at = lt + 1
            continue
        if lt > at:
            stack[-1].children.append(_html.unescape(page[at:lt]))
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            if m["cdata"]:
                stack[-1].children.append(m["cdata"])
            continue
        if m["close"] or m["close2"]:
            for depth in range(len(stack) - 1, 0, -1) if there[name] > 0 else ():
                if stack[depth].name == name:
                    close_to(depth)
                    break
                if stack[depth].name in SCOPE and name not in SCOPE:
                    break
            continue
        rest = m["rest"] if m["name"] else m["rest2"]
        if name in ("html", "body"):
            if name == "body" and not there["body"]:
                close_to(1)
                node = Node("body", root)
                root.children.append(node)
                opened(node)
            continue
        if name in ENDS_P and there["p"] > 0:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == "p":
                    close_to(depth)
                    break
                if stack[depth].name in SCOPE:
                    break
        if name in ENDS:
            ends, until = ENDS[name]
            for depth in range(len(stack) - 1, 0, -1) if any(there[x] > 0 for x in ends) else ():
                if stack[depth].name in ends:
                    close_to(depth)
                    if name != "tr" or stack[-1].name != "tr":
                        break
                elif stack[depth].name in until:
                    break
        if name[0] == "h" and len(name) == 2 and stack[-1].name[0] == "h" and len(stack[-1].name) == 2 and stack[-1].name not in VOID:
            close_to(len(stack) - 1)
        node = Node(name, stack[-1])
        stack[-1].children.append(node)
        hidden, hinted = _own_words(rest) if rest and not rest.isspace() else (False, 0)
        node.cut = hidden or name in NOT_TEXT
        node.hint = hinted
        if name in RAW:
            close = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(page, at)
            at = close.start() if close else end
        if name not in VOID:  # a slash closes nothing in HTML
            opened(node)
    return root


def _postorder(root: Node) -> list[Node]:
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(c for c in n.children if isinstance(c, Node))
    order.reverse()
    return order


def measure(order: list[Node]) -> None:
    """Counts, density and density sum of every node; `order` holds the nodes that were not cut, children first, the body last."""
    body = order[-1]
    for n in order:
        for c in n.children:
            if isinstance(c, str):
                n.chars += len(" ".join(c.split()))
            elif not c.cut:
                n.chars += c.chars
                n.tags += c.tags + (c.name not in INLINE)
                n.lchars += c.lchars
                n.ltags += c.ltags + (c.name == "a")
                if c.name in INLINE:
                    n.blocks += c.blocks
                else:
                    n.blocks.append(c)
        if n.name == "a":
            n.lchars = n.chars
    share = body.lchars / max(body.chars, 1)
    for n in order:
        n.density = _density(n, share)
        n.sum = sum(c.density for c in n.blocks)


def select(body: Node, order: list[Node]) -> set[int]:
    """The chosen nodes: best subtrees of the nodes that are as dense as the thinnest one between the body and the core."""
    if not body.chars:
        return set()
    nodes = [n for n in order if n.name not in INLINE or n is body]
    core = max(reversed(nodes), key=lambda n: n.sum)
    if core.sum <= 0:
        core = body
    threshold, up = core.density, core
    while up is not body:
        up = up.parent
        if up.name not in INLINE:
            threshold = min(threshold, up.density)
    best: dict[int, Node] = {}
    for n in nodes:
        best[id(n)] = max([n, *(best[id(c)] for c in n.blocks)], key=lambda x: x.sum)
    chosen: set[int] = set()
    stack = [body]
    while stack:
        n = stack.pop()
        if n.density >= threshold - 1e-9 and n.chars:
            b = best[id(n)]
            chosen.add(id(b if b.sum > 0 else n))
            stack.extend(n.blocks)
    heads = [n for n in nodes if n.name == "h1" and n.chars]
    if not any(_within(h, chosen) for h in heads):  # the title often stands beside its text, in a box of its own
        chosen.update(id(h) for h in heads)
    return chosen


def main_text(page: str | None) -> str:
    """The article's blocks, one a line; "" for null, empty or text-free pages."""
    if not page:
        return ""
    root = parse(page)
    order = _postorder(root)
    wide: dict[int, set[int]] = {1: set(), 2: set()}  # boxes of the title or the article: a hint on them is about the page
    for n in order:
        if n.cut or (n.name not in ("h1", "main") and (n.name != "article" or n.hint)):
            continue
        for kind in (1,) if n.name == "article" else (1, 2):
            up = n.parent
            while up is not None and id(up) not in wide[kind]:
                wide[kind].add(id(up))
                up = up.parent
    for n in order:
        if n.hint and n.name not in KEEP_WHOLE and n.name not in ("main", "h1") and id(n) not in wide[n.hint]:
            n.cut = True
    body = next((n for n in root.children if isinstance(n, Node) and n.name == "body"), root)
    order = []
    stack = [body]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(c for c in n.children if isinstance(c, Node) and not c.cut)
    order.reverse()
    measure(order)
    return "\n".join(_read(body, select(body, order)))



def _within(n: Node | None, chosen: set[int]) -> bool:
    while n is not None:
        if id(n) in chosen:
            return True
        n = n.parent
    return False


def _density(n: Node, share: float) -> float:
    if not n.chars:
        return 0.0
    c, t, lc, lt = n.chars, n.tags or 1, n.lchars or 1, n.ltags or 1
    plain = max(n.chars - n.lchars, 1)
    base = math.log(c * n.lchars / plain + share * c + math.e)
    value = math.log(max(c / lc * t / lt, 1.0))
    return c / t * (value / math.log(base) if base > math.e else value)


def _read(body: Node, chosen: set[int]) -> list[str]:
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    stack: list = [(body, id(body) in chosen, False)]
    while stack:
        n, inside, leaving = stack.pop()
        if isinstance(n, str):
            if inside:
                line.append(n)
            continue
        if n.name in BLOCK:
            flush()
        elif n.name == "br":
            line.append(" ")
        if leaving:
            continue
        stack.append((n, inside, True)) if n.name in BLOCK else None
        for c in reversed(n.children):
            if isinstance(c, str):
                stack.append((c, inside, False))
            elif not c.cut:
                stack.append((c, inside or id(c) in chosen, False))
    flush()
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of `pages` (page_id, url, html; others are ignored).

    A page is read whole, one at a time; null, empty and text-free pages give an empty text; a null page_id or url is kept;
    repeated rows each give a row; an empty table gives an empty result. Formulas and drawings (math, svg) are no text.
    """
    ship(pages.sparkSession)

    def run(batches):
        from aerograin.llm import textdensity as own

        for batch in batches:
            texts = [own.main_text(p.as_py()) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, SCHEMA)
