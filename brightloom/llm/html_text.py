"""HTML main text by composite text density.

The page becomes a tree of its elements with their text; scripts, styles and the like hold none. Every
node has C characters, T tags, LC characters and LT tags in links, menus and footers included; its density is

    C/T * ln(C/LC * T/LT) / ln(max(b, e)),  b = ln(C/(C-LC) * LC + LCb/Cb * C + e),  zero divisors as 1,

with LCb and Cb of the body, and C/T on a page without text in links. The floor e of the base keeps short texts
from growing without bound. A container's sum is the sum of the densities of its block children and of its
own running text. Menus, footers, asides, forms and hidden elements are evidence in the counts but add nothing to
sums and are not text. Names (class, id) of boilerplate only weigh densities by NAMED; containers in an
<article> or <main> count DECLARED times. A form or hidden element is no more than a strong hint, as whole pages
stand in one: where NAMED times the best sum inside it is above all sums outside, it is an ordinary element. So is
a dropped element without end tag, by UNCLOSED times its best sum.

The container with the largest sum is the core, or the outermost <article> around it. The smallest weighted
density on its path to the body is the threshold: named elements and lists of links below it are left out. Beside
the path a block joins if its weighted density reaches the threshold and JOIN times that of the path's own
subtree there; headings before the path join. A declared article is joined by other articles only.

Pages stay in their rows; nothing is shuffled. Null or empty html gives an empty text; repeated pages are read one by
one. Very long pages take time in proportion to their length. Broken markup never raises: unclosed elements end with
their parent, stray end tags are ignored, and a raw element (script, title) without end tag is an ordinary one.
After a tag whose quotes never end, tags are read to their first >. Only the three columns named are read; others may have any names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import exact

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_QUOTED_END = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?|"[^"]*"|'[^']*'""")

#: HTML's void, raw-text and block elements, and those that are never main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe annotation annotation-xml xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr caption ul".split()
)
CONTAINERS = frozenset("article blockquote body center details dir div dl figure main ol section table tbody td ul".split())
DROPPED = RAW | frozenset("nav footer aside form button head menu dialog header input label fieldset noscript template svg object select canvas".split())
CLOSES_P = BLOCK - {"body", "html", "tbody", "tfoot", "thead", "tr", "caption", "legend", "figcaption"}
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
P_STOPS = ("td", "th", "li", "table", "article", "section", "div", "body")
BARRIERS = frozenset("nav aside header footer form dialog fieldset button".split())
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar rail widget widgets header masthead topbar footer copyright "
    "comment comments commentlist disqus respond reply replies share sharing social related recommended pagination pager toolbar search".split()
)
LAYOUT = frozenset("has with without no is".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Weights: of a boilerplate name, of a declared article, and the share of the path's density that a block beside it needs.
NAMED, DECLARED, JOIN = 0.05, 2.0, 0.5
#: The weight of what stands in a dropped element that no end tag closes.
UNCLOSED = 0.5
#: Names of reader comments; they count on any element.
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
LINK_LIST, LINK_SHARE = 3, 0.9


class _Node:
    __slots__ = ("tag", "parent", "children", "link", "dropped", "hint", "closed", "weight", "in_article", "chars", "tags", "link_chars", "link_tags", "own_chars", "own", "below", "density", "sum")

    def __init__(self, tag: str, parent: _Node | None, dropped: bool = False, named: bool = False):
        self.tag, self.parent, self.dropped, self.closed = tag, parent, dropped, False
        self.hint = dropped and (tag == "form" or tag not in DROPPED)
        self.children: list[_Node | str] = []
        self.in_article = tag in ("article", "main") or bool(parent and parent.in_article)
        self.link = tag == "a" or bool(parent and parent.link)
        self.weight = (parent.weight if parent else 1.0) * (NAMED if named else 1.0)

    @property
    def named(self) -> bool:
        return self.parent is not None and self.weight < self.parent.weight

    @property
    def worth(self) -> float:
        return self.density * self.weight


def _judged(tag: str, attributes: str, in_article: bool = False) -> tuple[bool, bool]:
    """(dropped, named): by tag, role or hiding, and by class or id; the ids of sections and headings and the classes of headings in an article say what they are about."""
    if tag in DROPPED:
        return True, False
    if not attributes.strip() or tag in ("body", "html", "article", "main"):
        return False, False
    naming = () if in_article and tag in HEADINGS else ("class",) if in_article and tag == "section" else ("class", "id")
    named = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, False
        if name == "role" and value in ROLES:
            return True, False
        named = named or name in naming and any(map(_names_boilerplate, value.split()))
        named = named or tag == "section" and name == "id" and any(_names_boilerplate(v, COMMENTS) for v in value.split())
    return False, named


def _names_boilerplate(name: str, of: frozenset[str] = BOILERPLATE) -> bool:
    """A class or id with a telling word, unless it says that something has or lacks it, as has-sidebar does."""
    words = re.split(r"[^a-z]+", name)
    return words[0] not in LAYOUT and not of.isdisjoint(words)


def _markup(page: str) -> Iterator[tuple[str, str, str, int]]:
    """(text before, tag name with its slash, attributes, place after) in order; comments and the like have no name."""
    at = seen = 0  # text goes on from at; the next < is looked for from seen
    quotes = True
    unclosed: set[str] = set()
    while (start := page.find("<", seen)) >= 0:
        seen = start + 1
        mark = page[start + 1 : start + 2]
        if mark in ("!", "?"):
            opening = next((o for o in ("<!--", "<![CDATA[") if page.startswith(o, start)), "")
            stop = {"<!--": "-->", "<![CDATA[": "]]>"}.get(opening, ">")
            end = page.find(stop, start + len(opening or "<"))
            if end < 0 and not opening:
                break
            yield page[at:start], "", "", start
            at = seen = len(page) if end < 0 else end + len(stop)
            continue
        if not (m := _NAME.match(page, start + 1)):
            continue
        end = _QUOTED_END.match(page, m.end()) if quotes else None
        quotes = quotes and end is not None
        to = end.end() if end else page.find(">", m.end()) + 1
        if not to:
            break
        name = m[0].lower()
        yield page[at:start], name, page[m.end() : to - 1], to
        at = seen = to
        if name in RAW and name not in unclosed:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(page, to)
            if close:
                yield "", "/" + name, "", close.end()
                at = seen = close.end()
            else:
                unclosed.add(name)
    yield page[at:], "", "", len(page)


def _tree(page: str) -> _Node:
    """The page's tree; strings are decoded text, and a lone newline stands for each line break."""
    root = node = _Node("body", None)
    opened: Counter[str] = Counter()

    def leave(to: _Node) -> _Node:
        nonlocal node
        while node is not to:
            opened[node.tag] -= 1
            node = node.parent
        return node

    for text, name, attributes, _ in _markup(page):
        if node.tag == "head" and text.strip():
            leave(node.parent)
        if text:
            node.children.append(unescape(text) if "&" in text else text)
        if not name:
            continue
        if name[0] == "/":
            name = name[1:]
            if name in ("body", "html"):
                leave(root)
            elif opened[name] > 0:
                above = node
                while above.tag != name:
                    above = above.parent
                above.closed = True
                leave(above.parent)
            continue
        if node.tag == "head" and name not in ("html", "base", "link", "meta", *RAW):
            leave(node.parent)
        if name in ("html", "body"):
            continue
        if name == "br":
            node.children.append("\n")
            continue
        leave(_closed_for(node, name, opened))
        dropped, named = _judged(name, attributes, node.in_article)
        child = _Node(name, node, dropped, named)
        node.children.append(child)
        if name not in VOID and not (dropped and attributes.endswith("/")):
            node = child
            opened[name] += 1
    return root


def _closed_for(node: _Node, name: str, opened: Counter[str]) -> _Node:
    """Where a start tag goes: it ends an open item of its own kind, or an open paragraph."""
    for ends, stops in ((SAME_CLOSES.get(name, ()), STOPS.get(name, ())), (("p",) if name in CLOSES_P else (), P_STOPS)):
        if not any(opened[e] > 0 for e in ends):
            continue
        above, found = node, None
        while above is not None and above.tag not in stops and above.tag not in BARRIERS:
            if above.tag in ends:
                found = above
            above = above.parent
        if found is not None:
            return found.parent
    return node


def _post_order(root: _Node) -> list[_Node]:
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if not isinstance(c, str)]
    return order[::-1]


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """share: of the body's characters, those in links."""
    tags = tags or 1
    if not chars or not share:
        return chars / tags
    inside = chars / (link_chars or 1) * tags / (link_tags or 1)
    base = math.log(chars / ((chars - link_chars) or 1) * link_chars + share * chars + math.e)
    return chars / tags * math.log(inside) / math.log(max(base, math.e))


def _measure(order: list[_Node]) -> None:
    """Counts, densities and sums; what is dropped only by a hint is so while the sums outside bear it out."""
    _count(order)
    while True:
        _sum_up(order)
        if not (wrong := _wrongly_dropped(order)):
            return
        for n in wrong:
            n.dropped = False


def _count(order: list[_Node]) -> None:
    for n in order:
        nodes = [c for c in n.children if not isinstance(c, str)]
        text = sum(len("".join(c.split())) for c in n.children if isinstance(c, str))
        n.chars = text + sum(c.chars for c in nodes)
        n.tags = sum(c.tags + 1 for c in nodes)
        n.link_chars = n.chars if n.link else sum(c.link_chars for c in nodes)
        n.link_tags = sum(c.link_tags + (c.tag == "a") for c in nodes)
        n.own_chars = text


def _sum_up(order: list[_Node]) -> None:
    body = order[-1]
    share = body.link_chars / (body.chars or 1)
    for n in order:
        n.density = density(n.chars, n.tags, n.link_chars, n.link_tags, share)
        # running text: characters, tags, link characters and tags of the strings and of inline elements; below: worth of the blocks
        own, n.below = [n.own_chars, 0, n.own_chars if n.link else 0, 0], 0.0
        for c in n.children:
            if isinstance(c, str) or c.dropped:
                continue
            if c.tag in BLOCK:
                n.below += c.worth
            else:
                n.below += c.below
                own = [a + b for a, b in zip(own, (c.own[0], c.own[1] + 1, c.own[2], c.own[3] + (c.tag == "a")), strict=True)]
        n.own = own
        n.sum = n.below + n.weight * density(*own, share)


def _wrongly_dropped(order: list[_Node]) -> list[_Node]:
    """The dropped elements on the way to the best sum, if it stands in hinted ones only and outweighs all sums outside of them."""
    weights: dict[int, float] = {}  # 1 outside of what is dropped, 0 where nothing speaks for it
    best, most, outside = None, 0.0, 0.0
    for n in reversed(order):  # parents first
        weight = weights[id(n.parent)] if n.parent is not None else 1.0
        if n.dropped:
            weight *= NAMED if n.hint else UNCLOSED if not n.closed and n.tag not in VOID else 0.0
        weights[id(n)] = weight
        if n.tag in CONTAINERS or n.dropped and weight:
            worth = n.sum * weight * (DECLARED if n.in_article else 1.0)
            if weight == 1.0:
                outside = max(outside, worth)
            elif worth > most:
                best, most = n, worth
    found = []
    while most > outside and best is not None:
        found += [best] if best.dropped else []
        best = best.parent
    return found


def _core(order: list[_Node]) -> _Node:
    """The container with the largest sum, of equal ones the outermost, or the outermost <article> around it."""
    shut: set[int] = set()
    best, most = order[-1], -1.0
    for n in reversed(order):  # parents first
        if n.dropped or n.parent is not None and id(n.parent) in shut:
            shut.add(id(n))
        elif n.tag in CONTAINERS and (worth := n.sum * (DECLARED if n.in_article else 1.0)) > most:
            best, most = n, worth
    above = best
    while above is not None:
        best = above if above.tag == "article" else best
        above = above.parent
    return best


def _marked(order: list[_Node]) -> tuple[float, set[int], set[int]]:
    """The threshold, the nodes whose subtree is text, and those whose own running text is."""
    core = node = _core(order)
    threshold, above = core.worth, core
    while above is not None:
        threshold, above = min(threshold, above.worth), above.parent
    share = order[-1].link_chars / (order[-1].chars or 1)
    marked, running = {id(core)}, set()
    while (parent := node.parent) is not None:
        least, before = max(threshold, JOIN * node.worth), True
        for c in parent.children:
            if c is node:
                before = False
            elif not isinstance(c, str) and not c.dropped and c.tag in BLOCK:
                joins = c.worth >= least and (not core.in_article or c.tag == "article")
                if joins or before and c.tag in HEADINGS and not c.named:
                    marked.add(id(c))
        if not core.in_article and parent.own[0] and parent.weight * density(*parent.own, share) >= least:
            running.add(id(parent))
        node = parent
    return threshold, marked, running


def _left_out(node: _Node, threshold: float) -> bool:
    """Inside the text: dropped, or below the threshold and named, or a list of links outside of declared articles."""
    if node.dropped:
        return True
    if node.worth >= threshold:
        return False
    links = node.tag in BLOCK and not node.in_article and node.link_tags >= LINK_LIST and node.link_chars >= LINK_SHARE * node.chars
    return node.named or links


def main_text(page: str | None) -> str:
    if not page:
        return ""
    body = _tree(page)
    order = _post_order(body)
    _measure(order)
    if not body.chars:
        return ""
    threshold, marked, running = _marked(order)
    blocks: list[str] = []
    words: list[str] = []

    def end_block() -> None:
        if block := " ".join("".join(words).split()):
            blocks.append(block)
        words.clear()

    todo: list[tuple[object, int]] = [(body, 0)]  # 2: all of it is text, 1: its running text is
    while todo:
        item, inside = todo.pop()
        if item is None:
            end_block()
        elif isinstance(item, str):
            if inside:
                words.append(item)
        elif item.dropped or inside == 2 and _left_out(item, threshold):
            end_block() if item.tag in BLOCK else words.append(" ")
        else:
            inside = 2 if id(item) in marked else max(inside, int(id(item) in running))
            if item.tag in BLOCK:
                end_block()
                todo.append((None, 0))
            elif item.tag in ("td", "th"):
                words.append(" ")
            todo += [(c, inside if inside == 2 or isinstance(c, str) or c.tag not in BLOCK else 0) for c in reversed(item.children)]
    end_block()
    return "\n\n".join(blocks)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) per row."""
    rows = pages.select(exact(id_col), exact(url_col), exact(html_col)).toDF("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                text = pa.array([main_text(x) for x in part.column(2).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), text], names=["page_id", "url", "text"])

    return rows.mapInArrow(run, T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType())]))
