"""Pages with elements that nobody closed."""

from __future__ import annotations

import pytest
from tallyframe.llm import html


@pytest.mark.parametrize("tag", "button select object iframe canvas svg audio video math template".split())
def test_unclosed_elements_keep_the_rest(tag):
    assert [b.text for b in html.text_blocks(f"<p>one</p><{tag} class=x><p>two</p><{tag}><p>three</p>")] == ["one", "two", "three"]
    assert [b.text for b in html.text_blocks(f"<p>one</p><{tag}>gone</{tag}><p>two</p>")] == ["one", "two"]


def test_a_later_button_is_not_the_end_of_an_open_one():
    assert [b.text for b in html.text_blocks("<button><p>one</p><button>gone</button><p>two</p>")] == ["one", "two"]


@pytest.mark.parametrize("tag", "script style noscript textarea title".split())
def test_unclosed_raw_text_takes_the_rest(tag):
    assert [b.text for b in html.text_blocks(f"<p>one</p><{tag}><p>two</p>")] == ["one"]


LONG = " ".join(["several plain words of an article that goes on"] * 4)


@pytest.mark.parametrize("opened", ['div class="page no-sidebar"', 'div class="layout with-sidebar"', 'main class="with-sidebar"', 'div class="legal-analysis"', 'div class="hasComments"', 'div id="cookie-recipes"'])
def test_names_of_layouts_and_subjects_take_no_article(opened):
    page = f"<body><{opened}><nav><a href=x>menu</a></nav><p>{LONG}</p><p>{LONG} too.</p></{opened.split()[0]}><footer>end</footer></body>"
    assert html.main_text(page, html.default_tree()) == f"{LONG}\n{LONG} too."


@pytest.mark.parametrize("opened", ['div class="sidebar-left"', 'div class="legal notice"', 'div class="share-buttons"', 'div class="relatedArticles"', 'div class="site-footer"', 'div id="google-ad"', 'div class="post-comments"'])
def test_names_of_boilerplate(opened):
    page = f"<article><p>{LONG}</p><{opened}><p>{LONG} not this</p></div><p>{LONG} too.</p></article>"
    assert html.main_text(page, html.default_tree()) == f"{LONG}\n{LONG} too."


def test_items_headings_and_spans_read_their_names():
    page = (
        f'<article><p>{LONG} <span class="share">Share <span>this</span></span> on.</p><ul><li>one<li class="ad">buy<li>two</ul>'
        f'<h3 class="related">See also</h3><p>{LONG}</p><p>a <span class=share>open</p><p>{LONG}</p></article>'
    )
    assert html.main_text(page, html.default_tree()) == f"{LONG} on.\none\ntwo\n{LONG}\na\n{LONG}"


def test_a_wrapper_with_all_of_the_text_is_no_boilerplate():
    text = " ".join([LONG] * 4)
    assert html.main_text(f'<nav><a href=x>menu</a></nav><div class="widget"><p>{text}</p></div>', html.default_tree()) == text
    assert html.main_text(f'<div class="widget"><p>{LONG}</p></div>', html.default_tree()) == ""
    assert html.main_text(f'<aside><p>{text}</p></aside><div class="comments"><p>{text}</p></div>', html.default_tree()) == ""
