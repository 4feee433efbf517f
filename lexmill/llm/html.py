"""HTML main text by composite text density.

Every node gets its characters per tag, adjusted by how much of it is links (the composite text
density); a node's density sum is that of its child nodes' densities. The node of the greatest sum is
the main text. The least density on its path to the page's root is the threshold from which parts beside
it belong to the text too. What names, roles and landmark tags mark as boilerplate counts in all measures
but is neither chosen nor rendered, and a node within an article or main stands for all of that: on pages that are
marked up well these marks decide, not the sums. With ``marks`` off, density decides alone.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
#: An attribute's whole name and its value, so that nothing is found inside a value or at the end of another name.
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
# Elements by their role in the HTML standard, and names that mark boilerplate.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe object svg textarea title select button canvas audio video head".split())
_OPAQUE = frozenset("script style textarea title iframe noscript template".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul caption".split())
_CELL = frozenset("td th".split())
_BOILER = frozenset("nav header footer aside form menu dialog fieldset search".split())
_ENDS_P = _BLOCK - frozenset("html body option optgroup tr tbody thead tfoot caption li dd dt summary legend figcaption".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer sidebar side aside widget widgets comment comments respond disqus reply replies notice notices cookie cookies consent "
    "gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended pagination pager toolbar skip".split())
_CONTENT = frozenset("article main".split())
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split())
#: What marks a part of an article, and a paragraph or heading in it: without names that such parts have themselves.
_OWN_NAMES, _OWN_TEXTS = _NAMES - frozenset("related recommended".split()), _NAMES - frozenset("related recommended share sharing social".split())
_LEAF = _TEXT - {"blockquote"} | frozenset("li tr dt dd hr".split())
_STATES = frozenset("has with no without".split())


class Node:
    __slots__ = ("tag", "kids", "up", "inside", "silent", "marked", "chars", "links", "tags", "link_tags", "density", "total")

    def __init__(self, tag: str, up: Node | None, attrs: str = "") -> None:
        self.tag, self.up, self.kids = tag, up, []
        self.inside = tag in _CONTENT or up is not None and up.inside
        hidden, marked = _judge(tag, attrs, up is not None and up.inside)
        self.silent, self.marked = tag in _RAW or hidden, marked
        self.chars = self.links = self.tags = self.link_tags = 0
        self.density = self.total = 0.0


def _judge(tag: str, attrs: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is not shown, and whether its tag, role or names mark it as boilerplate.

    Within an article or main only whole names count, not their parts, and not those that an article's own parts
    have (related; of a paragraph or heading, share too); ``has-sidebar`` and the like say what a page has and mark nothing.
    """
    hidden, marked = False, tag in _BOILER
    names = _NAMES if not inside else _OWN_TEXTS if tag in _TEXT else _OWN_NAMES
    if attrs and tag not in ("html", "body", "article", "main"):
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                hidden = True
            elif name == "role":
                marked |= value.lower() in _ROLES
            elif name in ("class", "id"):
                for part in value.split():
                    words = [part.lower()] if inside else [w.lower() for w in _SPLIT.split(part)]
                    marked |= words[0] not in _STATES and not names.isdisjoint(words)
    return hidden, marked


def parse(text: str) -> Node:
    """A tree from any text: unclosed elements end where an ancestor does, an unended tag is dropped."""
    root = Node("html", None)
    node, at, n = root, 0, len(text)

    def close(to: Node) -> None:
        nonlocal node
        node = to.up or root

    while at < n:
        m = _TOKEN.search(text, at)
        if m is None:
            node.kids.append(text[at:])
            break
        if m.start() > at:
            node.kids.append(text[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if m["cdata"] is not None or not tag:
            continue
        if m["close"]:
            x = node
            while x is not None and x.tag != tag:
                x = x.up if x.tag not in ("td", "th", "table") or tag in _BLOCK or tag in _CELL else None
            if x is not None and x is not root:
                close(x)
            continue
        if tag in ("html", "body"):
            if tag == "body":
                while node.tag == "head":
                    close(node)
            continue
        if tag in _ENDS_P or tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            ends = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}.get(tag, {"p"})
            stop = {"ul", "ol", "dl", "table", "select", "article", "main", "section", "div", "blockquote", "td", "th"} - ends
            if tag == "tr":
                stop -= {"td", "th"}
            x = node
            while x is not None and x.tag not in ends and x.tag not in stop:
                x = x.up
            if x is not None and x.tag in ends:
                close(x)
        child = Node(tag, node, m["attrs"] or "")
        node.kids.append(child)
        if tag in _OPAQUE:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(text, at)
            at = end.end() if end else n
        elif tag not in _VOID and not (m["attrs"] or "").endswith("/"):
            node = child
    return root


def _post_order(root: Node) -> list[Node]:
    stack, out = [root], []
    while stack:
        x = stack.pop()
        out.append(x)
        stack += [k for k in x.kids if isinstance(k, Node)]
    return out[::-1]


def measure(root: Node) -> None:
    """Characters, tags and links of every node, its composite density, and the sum over its child nodes.

    The density of a node of C characters (LC of them in links, the rest outside) and T tags (LT of them
    links) is ``C/T * log(C/LC * T/LT)`` to the base ``ln(C/(C - LC) * LC + LCb/Cb * C + e)``, with the body's
    LCb and Cb and any zero divisor taken as one. On a page without links no adjustment is defined and the
    density is C/T. Marked nodes count in all of this, but give nothing to their parent's sum.
    """
    order = _post_order(root)
    for x in order:
        own = 0
        if x.silent:
            continue
        for k in x.kids:
            if isinstance(k, str):
                own += sum(map(len, entities.unescape(k).split()))
            elif not k.silent:
                x.chars += k.chars
                x.links += k.links
                x.tags += k.tags + 1
                x.link_tags += k.link_tags + (k.tag == "a")
        x.chars += own
        if x.tag == "a":
            x.links = x.chars
    share = root.links / max(1, root.chars)
    for x in order:
        if x.silent or not x.chars:
            continue
        x.density = x.chars / max(1, x.tags)
        if root.links:
            ratio = x.chars / max(1, x.links) * max(1, x.tags) / max(1, x.link_tags)
            base = math.log(x.chars / max(1, x.chars - x.links) * x.links + share * x.chars + math.e)
            x.density *= max(0.0, math.log(ratio)) / math.log(base)
        x.total = sum(k.density for k in x.kids if isinstance(k, Node) and not k.marked)


def unmark(root: Node) -> None:
    """An article or main is no boilerplate for what is around it, nor is an article's header with its heading."""
    content, headed = set(), set()
    for x in _post_order(root):
        kids = [k for k in x.kids if isinstance(k, Node) and not k.silent]
        if any(k.tag in _CONTENT or id(k) in content for k in kids):
            content.add(id(x))
        if any(k.tag == "h1" or id(k) in headed for k in kids):
            headed.add(id(x))
        if not x.inside and id(x) in content or x.inside and x.tag == "header" and id(x) in headed:
            x.marked = False


def select(root: Node) -> list[Node]:
    """The node of the greatest density sum, and the parts beside its path that are as dense as that path.

    A node within an article or main stands for all of that. A part beside is one of block level that is a paragraph or heading itself or has a density sum, so that
    a lone line of text is none; of it the node of the greatest sum is taken. In page order.
    """
    boxes, stack = [], [root]
    while stack:
        x = stack.pop()
        if not x.silent and not x.marked:
            boxes.append(x)
            stack += [k for k in reversed(x.kids) if isinstance(k, Node)]
    best = _densest(root)
    if not best.total:
        return [root]
    while best.inside and best.tag not in _CONTENT:
        best = best.up
    path = [best]
    while path[-1].up is not None:
        path.append(path[-1].up)
    threshold, on_path = min(x.density for x in path), set(map(id, path))
    chosen = {id(best)}
    for x in path[1:]:
        for k in x.kids:
            if isinstance(k, Node) and id(k) not in on_path and not k.silent and not k.marked and k.tag in _BLOCK and k.density >= threshold and (k.total or k.tag in _TEXT):
                chosen.add(id(_densest(k)))
    return [x for x in boxes if id(x) in chosen]


def _densest(top: Node) -> Node:
    """Of a node and the blocks within that can hold paragraphs, the one of the greatest density sum."""
    best, stack = top, [top]
    while stack:
        x = stack.pop()
        if not x.silent and not x.marked:
            if x.total > best.total and x.tag in _BLOCK and x.tag not in _LEAF:
                best = x
            stack += [k for k in x.kids if isinstance(k, Node)]
    return best


def render(nodes: list[Node]) -> str:
    """Blocks in page order, joined by newlines; white space in a block is one space. Nothing marked or silent."""
    blocks, buf = [], []

    def flush() -> None:
        if text := " ".join("".join(buf).split()):
            blocks.append(text)
        buf.clear()

    tops = set(map(id, nodes))
    stack: list[tuple[Node | str, bool]] = [(x, False) for x in reversed(nodes)]
    while stack:
        x, ended = stack.pop()
        if isinstance(x, str):
            buf.append(entities.unescape(x))
        elif ended:
            flush()
        elif not x.silent and not x.marked:
            if x.tag == "br" or x.tag in _CELL:
                buf.append(" ")
            if x.tag in _BLOCK or id(x) in tops:
                flush()
                stack.append((x, True))
            stack += [(k, False) for k in reversed(x.kids)]
    flush()
    return "\n".join(blocks)


def main_text(page: str | None, *, marks: bool = True) -> str:
    """Main text of one page; empty for null, blank or pages without text. ``marks`` off: by density alone."""
    root = parse((page or "").replace("\r\n", "\n").replace("\x00", ""))
    if marks:
        unmark(root)
    else:
        for x in _post_order(root):
            x.marked = x.inside = False
    measure(root)
    return render(select(root))


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: ``page_id, url, text, n_chars``; map-only, whole pages, any size.

    Null html counts as empty; null ids, urls and repeated rows pass through. Other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [main_text(h) for h in pdf["html"]]
            yield pd.DataFrame({"id": pdf["id"].astype("Int64"), "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})

    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return own.mapInPandas(run, "id long, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
