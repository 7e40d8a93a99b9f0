"""Extraction from labelled pages: wrappers around whole pages, what stands beside an article, hostile tags."""

import collections
import itertools
import time

import pytest

from ledgerline.llm import html_text

SENTENCE = "The river rises in the hills, runs north for a while, and then turns east towards the plain."
ARTICLE = [f"{SENTENCE} Part {k} follows." for k in range(5)]
BODY = "<h1>On rivers</h1>" + "".join(f"<p>{t}</p>" for t in ARTICLE)
WANT = "\n".join(["On rivers", *ARTICLE])
NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
AD = '<div class="ad">Buy two, pay one.</div>'
COMMENTS = '<div class="comments">' + "".join(f"<p>I disagree, sir, wholly, and at length, for reason {k}, which I'll set out here in full.</p>" for k in range(7)) + "</div>"
SIDEBAR = '<div class="sidebar"><h3>Latest</h3><a href=1>One story</a><a href=2>Another story</a><p>Short teaser text.</p></div>'
FORM = '<form class="newsletter"><label>Mail</label><input name=m><p>Subscribe to our letter, please.</p></form>'
FOOTER = "<footer>All rights reserved</footer>"

WRAPPERS = {
    "plain": "{}",
    "webform": '<form id="aspnetForm" method="post"><input type=hidden name=v>{}</form>',
    "form in div": '<div id="page"><form action="/">{}</form></div>',
    "has-sidebar": '<div class="layout has-sidebar">{}</div>',
    "no-sidebar": '<div class="page no-sidebar">{}</div>',
    "sidebar-right": '<div class="sidebar-right page">{}</div>',
    "menu-content": '<div class="menu-content">{}</div>',
    "modal-open": '<div class="modal-open">{}</div>',
    "header wrapper": '<div class="header-fixed">{}</div>',
    "role form": '<div role="form">{}</div>',
    "popup": '<section id="popup-root">{}</section>',
}
ARTICLES = {
    "article": "<article>{}</article>",
    "div in article": '<article><div class="overlay-text">{}</div></article>',
    "main": "<main>{}</main>",
    "post": '<div class="post">{}</div>',
}


def f1(got, want):
    a, b = collections.Counter(got.split()), collections.Counter(want.split())
    both = sum((a & b).values())
    return 2 * both / max(1, sum(a.values()) + sum(b.values()))


PAGES = [(w, a, f"<html><body>{WRAPPERS[w].format(NAV + AD + ARTICLES[a].format(BODY) + around)}{FOOTER}</body></html>") for w, a in itertools.product(WRAPPERS, ARTICLES) for around in ("", SIDEBAR + FORM, COMMENTS)]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_labelled_pages(wrapper):
    scores = {(a, k): f1(html_text.main_text(p), WANT) for k, (w, a, p) in enumerate(PAGES) if w == wrapper}
    assert len(scores) == 12 and min(scores.values()) > 0.99, scores


def test_wrappers_that_lost_the_article():
    text = " ".join(ARTICLE)
    for page in (f'<body><form id="aspnetForm"><p>{text}</p></form></body>', f'<div class="layout has-sidebar"><article><p>{text}</p></article></div>', f'<div class="page no-sidebar"><article><p>{text}</p></article></div>', f'<article><div class="overlay-text"><p>{text}</p></div></article>', f'<div class="menu-content"><p>{text}</p></div><div class="other"><p>Short, other, text.</p></div>'):
        assert html_text.main_text(page) == text


def test_suspects_beside_an_article_go():
    for beside in (COMMENTS, SIDEBAR, AD, FORM, '<div class="cookie-banner"><p>We use cookies, as all do, on this page, and you agree.</p></div>', '<div class="sidebar"><article><p>A teaser.</p></article></div>'):
        assert html_text.main_text(f"<body><article>{BODY}</article>{beside}</body>") == WANT
        if "<article>" not in beside:
            assert html_text.main_text(f"<body><article>{BODY}{beside}</article></body>") == WANT


@pytest.mark.parametrize("page", [lambda n: "<div>" * n + "</section>" * n, lambda n: "<ul>" * n + "<p>x" * n, lambda n: "<ul><li><ol>" + "<div>" * n + "<li></li>" * n, lambda n: "<table><tr><td>" + "<section>" * n + "<td></td>" * n, lambda n: "<blockquote>" * n + "</p>" * n, lambda n: "<select><button>" * n, lambda n: "<span class=ad>" * n + "<b class=ad>" * n, lambda n: '<div class="ad">x' * n, lambda n: "<p>" * n + "</div>" * n])
def test_hostile_tags_take_linear_time(page):
    took = []
    for n in (2000, 16_000):
        text = page(n)
        began = time.process_time()
        html_text.main_text(text)
        took.append(time.process_time() - began)
    assert took[1] < 16 * took[0] + 0.5
