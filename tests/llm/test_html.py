import html as entities
import re

import numpy as np
import pytest

from quadrill.llm import html

LONG = "A long paragraph of the article, with enough words to stand out from what surrounds it on the page. " * 3


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{a:b}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


CASES = {
    "article": (page(f"<nav><a href=/>Home</a></nav><article><h1>Head</h1><p>{LONG}</p><p>Short.</p></article><footer>&copy; x</footer>"), ["Head", LONG, "Short."]),
    "white space and references": (page(f"<article><p>\n a&nbsp;b  &lt;i&gt;\t&eacute;<b>x</b>y<br>z </p><p>{LONG}</p></article>"), ["a b <i> éxy z", LONG]),
    "no article": (page(f'<div class="menu">Home News</div><div id=content><h2>Head</h2><p>{LONG}</p><p>{LONG}</p><p>End.</p></div><div class="sidebar"><p>{LONG}</p></div>'), ["Head", LONG, LONG, "End."]),
    "inside the article": (page(f'<article><p>{LONG}</p><aside>More</aside><form><p>Mail</p><input></form><div class="ad">Buy</div><p>Mid</p><section id="comments"><p>{LONG}</p></section><p>End</p></article>'), [LONG, "Mid", "End"]),
    "roles and notices": (page(f'<div role="navigation">a b</div><div class="cookie-notice">{LONG}</div><main><p>{LONG}</p></main><div role=contentinfo>c</div>'), [LONG]),
    "header of page and of article": (page(f"<header><h1>Site</h1><p>Slogan</p></header><article><header><h1>Head</h1><p>by x</p></header><p>{LONG}</p></article>"), ["Head", LONG]),
    "open elements": (f"<html><body><nav><ul><li>a<li>b</ul></nav><article><p>{LONG}<p><b>Two<br><p>Three", [LONG, "Two", "Three"]),
    "scripts": (page(f"<article><p>{LONG}</p><script>if (a<b) document.write('<p>no</p>')</script><noscript>no</noscript><!-- no --><p>End</p></article>"), [LONG, "End"]),
    "list": (page(f"<article><p>{LONG}</p><ul><li>One</li><li>Two</li></ul></article>"), [LONG, "One", "Two"]),
    "only text": ("just text", ["just text"]),
    "nothing": (page("<nav>Home</nav><footer>x</footer>"), []),
    "null": (None, []),
    "empty": ("", []),
    "broken": ("<<<>&&<p", ["<<<>&&"]),
}


@pytest.mark.parametrize("wrapper", ["layout has-sidebar", "content no-sidebar", "entry share-on", "page with-header", "post related-posts-on", "sidebar", "site-header"])
@pytest.mark.parametrize("inside", ["article", "main", "div"])
def test_marked_wrappers_do_not_hide_the_page(wrapper, inside):
    got = html.main_text(page(f'<nav>Home</nav><div class="{wrapper}"><{inside}><h1>Head</h1><p>{LONG}</p><p>Short.</p></{inside}></div><footer>x</footer>'))
    assert got.split("\n") == ["Head", LONG.strip(), "Short."]


@pytest.mark.parametrize("marked", ["related", "related-posts", "site-sidebar", "comments", "comment-list", "promo"])
def test_marked_cards_beside_an_article_go(marked):
    got = html.main_text(page(f'<article><p>{LONG}</p></article><section class="{marked}"><article><p>{LONG} Card</p></article></section>'))
    assert got == LONG.strip()
    assert html.main_text(page(f'<section id="comments"><article><p>{LONG}</p></article></section>')) == ""


def test_many_open_elements():
    deep = "<div>" * 50000 + f"<p>{LONG}</p>" + "</span>" * 50000
    assert html.main_text(page(deep)) == LONG.strip()


@pytest.mark.parametrize("case", CASES)
def test_cases(case):
    got, want = html.main_text(CASES[case][0]), [w.strip() for w in CASES[case][1]]
    if case == "broken":
        assert isinstance(got, str)
    else:
        assert got.split("\n") == (want or [""])


def test_very_long_page():
    many = "".join(f"<p>{LONG} {k}</p>" for k in range(4000))
    got = html.main_text(page(f"<nav>x</nav><article>{many}</article>")).split("\n")
    assert len(got) == 4000 and got[3999].endswith("3999")


def test_smoothing_and_threshold():
    flat = html.ratios(np.full(9, 5.0), np.ones(9))
    assert np.allclose(flat, 5) and len(html.ratios(np.array([3.0, 1.0]), np.ones(2))) == 2 and len(html.ratios(np.array([3.0]), np.array([0]))) == 1
    assert 2 < html.threshold(np.array([1.0, 2.0, 90.0, 100.0])) < 90


def plain(source):
    """The article's blocks by patterns: these pages are simple enough."""
    inner = re.search(r"<article>(.*)</article>", source, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)\b[^>]*>", inner)
    blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " " if "<br" in b else "", re.sub(r"<(?!br)[^>]*>", "", b))).split()) for b in blocks]
    return "\n".join(b for b in blocks if b)


def test_query_against_patterns(spark):
    from quadrill.llm.queries import op4_html_extraction

    sf_dir = "/root/testdata/sf0.01"
    sources = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = op4_html_extraction(spark, sf_dir).collect()
    assert len(got) == len(sources)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (sources[r.page_id].url, plain(sources[r.page_id].html), len(r.text))


def test_odd_rows(spark):
    rows = [(1, "u", None, "x"), (1, None, "", "x"), (None, "u", page(f"<article><p>{LONG}</p></article>"), "x")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == [("1", 0), ("1", 0), ("None", len(LONG.strip()))]
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
