"""Pages whose dropped elements have no end tags, and attributes that only look like boilerplate."""

import pytest
from brightloom.llm.html_text import main_text

STORY = "This is the article of the page, long enough to count as text."


@pytest.mark.parametrize(
    "before",
    ["<ul><li class=menu>A<li>B</ul>", "<p class=notice>x", "<div><div class=ad><span>x</div></div>", "<table><tr><td class=sidebar>x<tr><td class=sidebar>y</table>", "<head><meta name=a>", "<head><title>T</title><body>"],
)
def test_dropped_elements_end_with_their_parent(before):
    assert main_text(f"<html>{before}<article><p>{STORY}</p></article></body></html>") == STORY


def test_dropped_elements_keep_what_they_hold_out():
    page = f"<article><p>{STORY}</p><nav><ul><li>a<li>b<nav>c</nav></ul><p>d<li>e</nav><p>One <button><div>f</div></button> two.</p></article>"
    assert main_text(page) == f"{STORY}\n\nOne two."


@pytest.mark.parametrize(
    "tag",
    ["p title='a hidden gem'", 'p data-hidden="false"', "p data-id=comments", "p data-class='ad banner'", "p data-x='class=ad' y", "h2 id=related-work", "h2 class='section-header'", "section id=social-impact", "math"],
)
def test_attributes_that_name_no_boilerplate(tag):
    assert main_text(f"<article><p>{STORY}</p><{tag}>More of it.</{tag.split()[0]}></article>").split() == f"{STORY} More of it.".split()


@pytest.mark.parametrize("tag", ["p hidden", "p HIDDEN=''", "p class = ad", "div id=comments", "section class=related", "p aria-hidden=true", "p style='display: none'", "div role=navigation", "h2 hidden"])
def test_attributes_that_name_boilerplate(tag):
    assert main_text(f"<article><p>{STORY}</p><{tag}>More of it.</{tag.split()[0]}></article>") == STORY
