"""Composite text density against a plain recursive version, pages without class names, and broken markup."""

import math
import random
import re
import time
from html import escape

import pandas as pd
import pytest
from brightloom.llm import html_text as H

STORY = "This is the real article of the page, long enough to count as text of its own."


def made(rng, depth=0, linked=False):
    """A random tree: (tag, children); strings are text."""
    tag = "a" if depth > 1 and not linked and rng.random() < 0.2 else rng.choice(["div", "section", "p", "b", "ul", "nav"])
    parts = []
    for _ in range(rng.randrange(1, 5)):
        inner = depth < 4 and tag not in ("p", "a", "b") and rng.random() < 0.6
        parts.append(made(rng, depth + 1, linked or tag == "a") if inner else " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(1, 30))))
    return tag, parts


def source(node):
    return escape(node) if isinstance(node, str) else f"<{node[0]}>{''.join(map(source, node[1]))}</{node[0]}>"


def plain(node, in_link=False):
    """(C, T, LC, LT) of a tree, by the definition."""
    if isinstance(node, str):
        n = len("".join(node.split()))
        return n, 0, n * in_link, 0
    inside = [plain(c, in_link or node[0] == "a") for c in node[1]]
    n = [sum(x) for x in zip(*inside, strict=True)] if inside else [0] * 4
    n[1] += sum(not isinstance(c, str) for c in node[1])
    n[3] += sum(not isinstance(c, str) and c[0] == "a" for c in node[1])
    return tuple(n)


def density(n, body):
    c, t, lc, lt = n
    t = t or 1
    if not c or not body[2]:
        return c / t
    b = math.log(c / ((c - lc) or 1) * lc + body[2] / body[0] * c + math.e)
    return c / t * math.log(c / (lc or 1) * t / (lt or 1)) / math.log(max(b, math.e))


@pytest.mark.parametrize("seed", range(40))
def test_density_is_that_of_the_definition(seed):
    tree = ("body", [made(random.Random(seed)) for _ in range(3)])
    order = H._post_order(H._tree("".join(map(source, tree[1]))))
    H._measure(order)
    body, want = plain(tree), []

    def visit(node):
        for c in node[1]:
            if not isinstance(c, str):
                visit(c)
        want.append((node[0], *(n := plain(node)), density(n, body)))

    visit(tree)
    got = sorted((n.tag, n.chars, n.tags, n.link_chars, n.link_tags, round(n.density, 9)) for n in order)
    assert got == sorted((*w[:-1], round(w[-1], 9)) for w in want)


def test_articles_are_found_without_class_names():
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet").html
    right = whole = 0
    for page in pages:
        article = re.search(r"<article>(.*)</article>", page, re.DOTALL)[1]
        want = H.main_text(f"<article>{article}</article>")
        assert H.main_text(page) == want
        bare = re.sub(r'\s(class|id)="[^"]*"', "", page)
        right += H.main_text(bare) == want
        undeclared = H.main_text(re.sub(r"<(/?)article>", r"<\1div>", bare))
        whole += want in undeclared
    assert right >= 0.98 * len(pages) and whole == len(pages)


@pytest.mark.parametrize(
    "page",
    ['<p class="notice">Cookie<p>{}', '<svg class="x"/><p>{}', '<li class="share">Share<li>{}', "<iframe><p>{}", "<header><article><p>{}</p></article>", "<script><p>{}", "<aside>x<article>{}</article></aside>"],
)
def test_unclosed_and_misplaced_elements_lose_no_text(page):
    assert H.main_text(page.format(STORY)) == STORY or page.startswith("<aside") and H.main_text(page.format(STORY)) == ""


def test_link_lists_and_asides_stay_out_and_link_paragraphs_in():
    links = "".join(f"<li><a href=/{i}>More link {i}</a></li>" for i in range(6))
    paragraphs = "".join(f"<p>{STORY} Number {i}.</p>" for i in range(4))
    page = f"<div><ul>{links}</ul></div><div><h1>Title</h1><div>{paragraphs}<p>See <a href=/x>this long link of the article</a>.</p><ul>{links}</ul></div><div>Short.</div></div><footer>F</footer>"
    got = H.main_text(page).split("\n\n")
    assert got == ["Title", *[f"{STORY} Number {i}." for i in range(4)], "See this long link of the article."]


@pytest.mark.parametrize("piece", ['<a href="x ', "<p", "<a '>", '<a "> "', "<!--", "<b>", "<li><p>", "</p>", "<svg>", "<script>", "<title>x", "<div class=ad>x", "<![CDATA[", "&amp;", "<p><button><b>"])
def test_broken_pages_take_linear_time(piece):
    began = time.time()
    got = H.main_text(f"<article><p>{STORY}</p></article>" + piece * (1_000_000 // len(piece) // 4))
    assert STORY in got and time.time() - began < 8


def test_long_and_repeated_pages(spark):
    long = "<article>" + f"<p>{STORY * 50}</p>" * 100
    pages = spark.createDataFrame([(1, "u", long, 0), (1, "u", long, 0), (2, None, None, 0)], "page_id int, url string, html string, text int")
    got = sorted((r.page_id, r.text) for r in H.extract(pages).collect())
    assert got == [(1, "\n\n".join([STORY * 50] * 100))] * 2 + [(2, "")]


_PARAGRAPHS = "".join(f"<p>The {w} paragraph of the story goes on for a while, with commas, and says what it has to say.</p>" for w in ("first", "second", "third", "fourth"))
_MENU = "<nav><ul>" + "".join(f"<li><a href=/{i}>Part {i}</a>" for i in range(9)) + "</ul></nav>"


@pytest.mark.parametrize("wrap", ["<form action=/x>{}</form>", '<div style="display:none">{}</div>', "<div hidden>{}</div>", "<form><div aria-hidden=true>{}</div></form>", "<form>{}", "<aside>{}", "<body><form id=f>{}</form><footer>All rights</footer>"])
def test_a_page_in_a_form_or_a_hidden_element_is_read(wrap):
    page = wrap.format(f"<header>Site</header>{_MENU}<div class=content><h1>Title</h1>{_PARAGRAPHS}</div><label>Your name</label><input>")
    text = H.main_text(page)
    assert text.startswith("Title\n\nThe first") and text.count("paragraph") == 4
    assert "Part" not in text and "Site" not in text and "rights" not in text


@pytest.mark.parametrize("extra", ["<form><p>Write to us, with your name and address, and we answer.</p><input></form>", "<div hidden><p>This text, of some length, is not shown to any reader of it.</p></div>", "<section id=comments><p>I like it, says a reader of the page.</p></section>", "<section id=user-comments><h3>Replies</h3><p>So do I, says another.</p></section>"])
def test_forms_hidden_elements_and_comments_beside_a_text_go(extra):
    page = f"<body>{_MENU}<article><h1>Title</h1>{_PARAGRAPHS}{extra}</article></body>"
    assert H.main_text(page) == H.main_text(page.replace(extra, ""))
