"""Main text against pages whose article is known, and against a second reading of the given pages."""

import html
import os
import re

import numpy as np
import pytest

from shelfcast.llm import maintext

SF = "/root/testdata/sf0.1"


def article(source):
    """Blocks of the one article of a given page, by patterns instead of events."""
    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", source, re.S).group(1)
    blocks = re.split(r"</?(?:p|h1)>", inner)
    blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in blocks]
    return "\n".join(b for b in blocks if b)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not present")
def test_query_equals_the_articles_of_the_given_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = maintext.op12_main_text(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == article(pages[r.page_id]), r.page_id
        assert r.n_chars == len(r.text)


LONG = "This is a sentence of the article that runs on for a while, as sentences in articles often do, until it ends. "
LINKS = "".join(f'<li><a href="/{i}">Section {i}</a></li>' for i in range(12))
CASES = {
    "plain divisions": (
        f"<html><body><div><ul>{LINKS}</ul></div><div id=x><h1>Title</h1><p>{LONG * 3}</p><p>Short.</p><p>{LONG * 2}</p></div>"
        f"<div><a href=/a>One</a> <a href=/b>Two</a> <a href=/c>Three</a></div></body></html>",
        f"Title\n{(LONG * 3).strip()}\nShort.\n{(LONG * 2).strip()}"),
    "all kinds of boilerplate": (
        f'<body class="has-sidebar"><header><h1>Site</h1></header><nav>{LINKS}</nav><div class="cookie-notice"><p>{LONG * 5}</p></div>'
        f'<main><article class="post"><header><h1>Head &amp; line</h1></header><p>A &lt;b&gt; c&nbsp;d &#233; &eacute;.</p>'
        f'<div class="ad-slot">{LONG * 4}</div><form><label>Mail</label><input><button>Go</button></form><p>End.</p>'
        f'<footer>{LONG}</footer></article><section id="comments"><article><p>{LONG * 6}</p></article></section></main>'
        f'<aside><p>{LONG * 9}</p></aside><div class="site_footer">{LONG}</div><script>var x = "<p>{LONG}</p>";</script></body>',
        "Head & line\nA <b> c d é é.\nEnd."),
    "unclosed menu": (f"<nav><ul>{LINKS}<article><h1>T</h1><p>One<p>Two <b>bold<br>more</article><footer>foot", "T\nOne\nTwo bold more"),
    "form around the page": (f"<form id=f><div><article><p>{LONG}</p><p>b</p></article></div></form>", f"{LONG.strip()}\nb"),
    "no blocks": ("just  some\n text", "just some text"),
    "only boilerplate": (f"<nav>{LINKS}</nav><footer>x</footer>", ""),
    "hidden parts": (f'<article><p>{LONG}</p><p hidden>no</p><div style="display: none">no</div><p>yes</p></article>', f"{LONG.strip()}\nyes"),
    "names of parts": (
        f'<article><p>{LONG}</p><ul class="user-comments-list"><li>{LONG}</li></ul><div class="page_cookie_box">{LONG}</div>'
        f'<div class="adapter">kept</div><div id="no-comments">kept too</div><p class="ADVERT">no</p></article>', f"{LONG.strip()}\nkept\nkept too"),
    "tables and lists": ("<article><table><tr><td>a<td>b</tr></table><ul><li>x<li>y</ul><pre>p  q</pre></article>", "a\nb\nx\ny\np q"),
    "truncated": ("<article><p>one &amp; two</p><p>three &am", "one & two\nthree &am"),
    "inside a comment": ("<article><p>a<!-- <p>no</p> -->b</p></article>", "ab"),
}


@pytest.mark.parametrize("name", CASES)
def test_known_pages(name):
    source, want = CASES[name]
    assert maintext.main_text(source) == want


def test_smoothing_is_a_weighted_mean():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 40):
        ratios = rng.random(n) * 100
        got = maintext.smoothed(ratios, 1.0)
        for k in range(n):
            near = range(max(0, k - 3), min(n, k + 4))
            w = [np.exp(-0.5 * (i - k) ** 2) for i in near]
            assert got[k] == pytest.approx(sum(a * ratios[i] for a, i in zip(w, near)) / sum(w))


def test_pieces_of_a_long_page_give_the_whole_text():
    words = [f"w{i}&amp;<b>x</b>" for i in range(40_000)]
    source = "<article><p>" + " ".join(words) + "</p></article>"
    assert maintext.main_text(source) == " ".join(f"w{i}&x" for i in range(40_000))


def test_deep_pages_take_no_square_of_their_length():
    assert maintext.main_text("<div>" * 20_000 + "<p>a</p>" * 20_000) == "\n".join("a" * 20_000)


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<p>a"), (3, "w", "<p>b"), (3, "w", "<p>b"), (4, "x", "<<< & <b"), (5, "y", "\0 <p>")]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(map(str, (tuple(r) for r in maintext.extracted(pages).collect())))
    assert len(got) == len(rows) and "(3, 'w', 'b', 1)" in got and "(1, 'u', '', 0)" in got and "(2, None, '', 0)" in got
    assert maintext.extracted(pages.filter("page_id < 0")).count() == 0
