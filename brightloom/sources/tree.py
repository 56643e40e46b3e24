"""A page as a tree, and the elements that a CSS selector names: the part of reading pages that column expressions can't do."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose open sibling of the same kind ends where one begins.
ENDS_ITSELF = frozenset("a li option tr td th dt dd p".split())


class Node:
    __slots__ = ("tag", "attributes", "parent", "children")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []

    def elements(self) -> Iterator[Node]:
        """All elements below, in page order."""
        todo = [iter(self.children)]
        while todo:
            child = next(todo[-1], None)
            if child is None:
                todo.pop()
            elif isinstance(child, Node):
                yield child
                todo.append(iter(child.children))

    def text(self, between: str = " ") -> str:
        """The texts below, trimmed and joined, without those of scripts and styles."""
        out, todo = [], [iter(self.children)]
        while todo:
            child = next(todo[-1], None)
            if child is None:
                todo.pop()
            elif isinstance(child, str):
                out.append(child.strip())
            elif child.tag not in ("script", "style"):
                todo.append(iter(child.children))
        return between.join(x for x in out if x)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.node = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_ITSELF and self.node.tag == tag:
            self.node = self.node.parent
        child = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.node)
        self.node.children.append(child)
        if tag not in VOID:
            self.node = child

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.node = self.node.parent

    def handle_endtag(self, tag: str) -> None:
        above = self.node
        while above is not None and above.tag != tag:
            above = above.parent
        if above is not None and above.parent is not None:
            self.node = above.parent

    def handle_data(self, data: str) -> None:
        self.node.children.append(data)


def parsed(page: str) -> Node:
    builder = _Builder()
    builder.feed(page)
    builder.close()
    return builder.root


_SIMPLE = re.compile(r"""([a-zA-Z][\w-]*|\*)|\#([\w-]+)|\.([\w-]+)|\[\s*([\w:-]+)\s*(?:([~|^$*]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+))\s*)?\]""")
_PART = r"""(?:\[[^\]]*\]|[^\s>\[])+|>"""
_TESTS = {
    "=": lambda own, v: own == v, "^=": lambda own, v: bool(v) and own.startswith(v), "$=": lambda own, v: bool(v) and own.endswith(v), "*=": lambda own, v: bool(v) and v in own,
    "~=": lambda own, v: v in own.split(), "|=": lambda own, v: own == v or own.startswith(v + "-"),
}


@lru_cache(maxsize=256)
def compiled(selector: str) -> tuple:
    """Alternatives of (relation, simple tests) from left to right; a selector that isn't understood is a ValueError."""
    groups = []
    for group in re.split(r""",(?![^\[]*\])""", selector):
        steps, relation = [], " "
        if re.sub(_PART, "", group).strip():
            raise ValueError(f"selector {selector!r}")
        for part in re.findall(_PART, group):
            if part == ">":
                relation = ">"
                continue
            tests, at = [], 0
            while at < len(part):
                m = _SIMPLE.match(part, at)
                if not m or (m[1] and at):
                    raise ValueError(f"selector {selector!r}")
                tests.append((m[1] and m[1].lower(), m[2], m[3], m[4] and m[4].lower(), m[5], next((x for x in m.group(6, 7, 8) if x is not None), None)))
                at = m.end()
            steps.append((relation, tuple(tests)))
            relation = " "
        if not steps or relation == ">":
            raise ValueError(f"selector {selector!r}")
        groups.append(tuple(steps))
    return tuple(groups)


def _fits(node: Node, tests: tuple) -> bool:
    own = node.attributes
    for tag, key, kind, attribute, relation, value in tests:
        if tag and tag not in ("*", node.tag) or key and own.get("id") != key or kind and kind not in own.get("class", "").split():
            return False
        if attribute and (attribute not in own or relation and not _TESTS[relation](own[attribute], value)):
            return False
    return True


def _is(node: Node, steps: tuple) -> bool:
    relation, tests = steps[-1]
    if not _fits(node, tests):
        return False
    if len(steps) == 1:
        return True
    above = node.parent
    while above is not None and above.tag:
        if _is(above, steps[:-1]):
            return True
        if relation == ">":
            return False
        above = above.parent
    return False


def select(root: Node, selector: str) -> Iterator[Node]:
    """Elements in page order that any alternative names."""
    groups = compiled(selector)
    return (n for n in root.elements() if any(_is(n, g) for g in groups))


_CDATA = re.compile(r"<!\[CDATA\[(.*?)\]\]>", re.DOTALL)
#: Types of scripts that hold a page's list as markup.
MARKUP_TYPES = ("text/xml", "application/xml")


def anchors(page: str, selector: str | None) -> Iterator[tuple[str, str]]:
    """(title, href) of the anchors of a page that the selector names, then of those in markup kept in scripts; the title attribute comes before the text."""
    root = parsed(page)
    trees = [root]
    for script in root.elements():
        if script.tag == "script" and script.attributes.get("type") in MARKUP_TYPES:
            raw = "".join(c for c in script.children if isinstance(c, str))
            trees += [parsed(f) for f in _CDATA.findall(raw) or ([raw] if raw else [])]
    for tree in trees:
        for a in select(tree, selector or "a"):
            yield " ".join((a.attributes.get("title") or a.text()).split()), a.attributes.get("href", "")
