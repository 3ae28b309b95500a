"""Main text of web pages by composite text density.

A page's elements become a tree. What is never main text by its element or its name (menus, headers, footers, asides,
adverts, forms, scripts, reader comments, ...) leaves it. For every other node the composite density is its characters
for each tag, adjusted by links: C/T * log((C/LC) * (T/LT)) to the base ln(C*LC/(C-LC) + LCb*C/Cb + e), where C are the
characters under it, T tags, LC and LT those of links, and b the body. A block's density sum is that of the blocks right
under it, whatever inline elements are between; a block without blocks has its own density. The densest sum on the page
is the main subtree (of equal sums that of an article or main element, then the first). The threshold is the least
density on the path from the body to it: blocks beside the path that reach it are main text too, and so are, inside the
path's containers, paragraphs, headings, lists and the like that aren't mostly links, which belong to the same flow.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filescope.llm.common import column, tidy, tune

#: Quotes count after an equals sign only.
_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z))", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")

# Fixed values of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag ends open elements of these names, up to one of the others; that of any block ends an open paragraph.
_CLOSES = {
    "li": (frozenset(["li", "p"]), frozenset("ul ol menu".split())),
    "dd": (frozenset("dd dt p".split()), frozenset(["dl"])),
    "dt": (frozenset("dd dt p".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th p".split()), frozenset("table".split())),
    "td": (frozenset("td th p".split()), frozenset("tr table".split())),
    "th": (frozenset("td th p".split()), frozenset("tr table".split())),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Elements of running text.
_FLOW = frozenset("blockquote details dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul".split())
#: Deeper elements are siblings, as in browsers.
_DEPTH = 512
#: Elements and words of a class, id or role whose text is never the article's.
_NOISE = frozenset("aside audio button canvas datalist dialog embed footer form head iframe map menu nav noembed noframes noscript object script search select style svg template textarea title video".split())
_NAMES = frozenset(
    "ad adbox ads adsbygoogle adsense adslot adunit advert adverts advertisement advertising advertorial alert alerts announcement banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disqus dialog footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination popup promo promoted promotion related recommended replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe taboola tags teaser teasers toast toolbar trending widget".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    """An element. chars and so on are sums over all it holds, once summed."""

    __slots__ = ("block", "chars", "density", "headings", "kids", "link_chars", "link_tags", "main", "name", "noise", "paragraphs", "parent", "sum", "tags")

    def __init__(self, name: str, parent: Node | None, noise: int) -> None:
        self.name, self.parent, self.noise, self.kids, self.block = name, parent, noise, [], name in _BLOCK


def _is_noise(name: str, attrs: str) -> int:
    """3: a form that isn't hidden; 2: by element, or hidden; 1: by a word of its names; 0: no noise."""
    if name in _NOISE and name != "form":
        return 2
    if name == "form":
        return 2 if _is_noise("div", attrs) == 2 else 3
    if not attrs or name in ("html", "body", "article", "main"):
        return 0
    found = 0
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return 2
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return 2
        elif key != "aria-hidden":
            for token in value.split():
                # A layout that has or lacks a sidebar isn't one.
                words = [w.lower() for w in _WORD.findall(token)]
                if words and words[0] not in ("has", "no", "with", "without") and not _NAMES.isdisjoint([*words, "".join(words)]):
                    found = 1
    return found


def parse(page: str) -> Node:
    """The tree of a page; text nodes are strings. Unclosed and stray tags are dealt with as browsers mostly do."""
    root = Node("#root", None, 0)
    stack, blocks = [root], [0]  # open elements, and where blocks are among them
    open_: dict[str, list[int]] = {}
    pos = 0

    def close(at: int) -> None:
        """Close the element at `at` and all that are open in it."""
        for x in stack[at:]:
            open_[x.name].pop()
            if x.block:
                blocks.pop()
        del stack[at:]

    while m := _TAG.search(page, pos):
        if m.start() > pos:
            stack[-1].kids.append(page[pos : m.start()])
        pos = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            at = open_.get(name)
            # An end tag inside a block doesn't close blocks around it, unless it is a block's own.
            if at and (name in _BLOCK or at[-1] > blocks[-1]):
                close(at[-1])
            continue
        if name in _BLOCK and stack[blocks[-1]].name == "p":
            close(blocks[-1])
        if rule := _CLOSES.get(name):
            found = None
            for at in reversed(blocks if name != "option" else range(len(stack))):
                if stack[at].name in rule[1]:
                    break
                if stack[at].name in rule[0]:
                    found = at
            if found:
                close(found)
        node = Node(name, stack[-1], _is_noise(name, m[3]))
        stack[-1].kids.append(node)
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, pos)
            pos = end.end() if end else len(page)
        elif name not in _VOID and not m[3].endswith("/") and len(stack) < _DEPTH:
            open_.setdefault(name, []).append(len(stack))
            if node.block:
                blocks.append(len(stack))
            stack.append(node)
    if pos < len(page):
        stack[-1].kids.append(page[pos:])
    return root


def _walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack += [k for k in reversed(x.kids) if type(k) is Node]


def _summed(root: Node) -> list[Node]:
    """All nodes, parents first, with the sums over what they hold; what is noise whatever else isn't counted."""
    nodes = list(_walk(root))
    for x in reversed(nodes):
        x.chars = x.tags = x.link_chars = x.link_tags = x.paragraphs = x.headings = x.main = 0
        for k in x.kids:
            if type(k) is str:
                x.chars += len(k.strip())
            elif k.noise < 2:
                link = k.name == "a"
                x.chars += k.chars
                x.tags += k.tags + 1
                x.link_chars += k.chars if link else k.link_chars
                x.link_tags += k.tags + 1 if link else k.link_tags
                x.paragraphs += k.paragraphs + (k.name == "p")
                x.headings += k.headings + (k.name in _HEADINGS)
                x.main += k.main + (k.name in ("article", "main"))
    return nodes


def _prune(root: Node) -> None:
    """Drop noise from the tree; of an article's own header the headings stay, and no heading goes by its names.

    A form that holds the page's article, or more text than is outside of forms, is the page's layout, and stays.

    What is noise by its names alone, but has over half of the page's text, in an article's structure, is the page's
    layout, and stays.
    """
    for x in _summed(root):
        if x.noise == 3 and (x.main or x.chars > root.chars):
            x.noise = 0
    _summed(root)
    half = root.chars / 2
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        kept = []
        for k in node.kids:
            if type(k) is Node:
                own = k.name in _HEADINGS or (k.name == "header" and inside)
                layout = k.chars > half and (k.paragraphs > 2 or k.headings or k.main or k.name in ("article", "main"))
                if k.noise >= 2 or (k.noise == 1 and not own and not layout) or (k.name == "header" and not inside):
                    continue
                if k.name == "header":
                    k.kids = [h for h in _walk(k) if h.name in _HEADINGS and h.noise < 2]
                stack.append((k, inside or k.name in ("article", "main")))
            kept.append(k)
        node.kids = kept


def _measure(root: Node) -> list[Node]:
    """All nodes with their densities and, for blocks, the sums of them."""
    nodes = _summed(root)
    body = next((x for x in nodes if x.name == "body"), root)
    share = body.link_chars / max(1, body.chars)
    for x in reversed(nodes):
        c, t, lc, lt = x.chars, max(1, x.tags), max(1, x.link_chars), max(1, x.link_tags)
        base = log(c * lc / max(1, c - lc) + share * c + e)
        x.density = c / t * log(max(1.0, c / lc * (t / lt))) / log(max(base, 1.01)) if c else 0.0
        inner = [k for k in x.kids if type(k) is Node]
        x.sum = sum(k.density if k.block else k.sum for k in inner)
        if x.block and not x.sum:
            x.sum = x.density
    return nodes


def select(root: Node) -> list[Node | str]:
    """The subtrees, and texts between them, of the main text, in page order."""
    _prune(root)
    nodes = _measure(root)
    body = next((x for x in nodes if x.name == "body"), root)
    best = max((x for x in _walk(body) if x.block or x is body), key=lambda x: (x.sum, x.name in ("article", "main")))
    if not body.chars:
        return []
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min(x.density for x in path)
    on_path, chosen = {id(x) for x in path}, []
    stack: list = [body]
    while stack:
        x = stack.pop()
        if type(x) is str or id(x) not in on_path or x is best:
            chosen.append(x)
            continue
        ahead, kept = True, []
        for k in x.kids:
            if type(k) is str:
                if x is not body:
                    kept.append(k)
            elif id(k) in on_path:
                ahead = False
                kept.append(k)
            elif k.chars:
                flow = k.name in _FLOW and 2 * k.link_chars <= k.chars if x is not body else ahead and k.name in _HEADINGS
                if flow or k.density >= threshold or (not k.block and x is not body):
                    kept.append(k)
        stack += reversed(kept)
    return chosen


def text_of(nodes: list[Node | str]) -> str:
    """Blocks in page order, one a line, with references decoded and white space made one space."""
    out: list[list[str]] = [[]]
    for root in nodes:
        if type(root) is Node and root.block:
            out.append([])
        stack: list = [root]
        while stack:
            x = stack.pop()
            if type(x) is str:
                out[-1].append(x)
            elif x is None:
                out.append([])
            elif x.name == "br":
                out[-1].append(" ")
            else:
                if x.name in _BLOCK:
                    out.append([])
                    stack.append(None)
                stack += reversed(x.kids)
    lines = (" ".join(html.unescape("".join(b)).split()) for b in out if b)
    return "\n".join(x for x in lines if x)


def main_text(page: str | None) -> str:
    return text_of(select(parse(page))) if page else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: the main text of each page and its code points.

    Null or empty pages, and pages without text: an empty text. Broken markup is read as far as it goes. Repeated rows:
    a row each. Extra columns are not read. An empty table: no rows.
    """
    tune(pages.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in column(batch, "html").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "page_id"), column(batch, "url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return own.mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
