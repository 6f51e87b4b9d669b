"""Main text against the markup of the given pages and against small pages."""

import html
import re
import time

import pytest
from conftest import SF

from codesift.llm import html_text as ht


def brute(page):
    """The article of the given pages: blocks are headings and paragraphs."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    body = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1)>", "\0", body.replace("<br>", " ")))
    blocks = [" ".join(html.unescape(b).split()) for b in body.split("\0")]
    return "\n\n".join(b for b in blocks if b)


def test_query_against_markup(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = ht.op2_text_to_tag(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        page = pages[r["page_id"]]
        assert r["text"] == brute(page["html"]) and r["url"] == page["url"] and r["n_chars"] == len(r["text"])


LONG = "A paragraph of the article that is long enough to be told from menus. "


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("  \n", ""), ("plain words", "plain words"), ("<p>1 &lt; 2 &amp;&#233;", "1 < 2 &é"),
    (f"<div id=top><a href=/>Home</a><a href=/a>About</a></div><div><h1>T</h1><p>{LONG}<p>Short.</div>", f"T\n\n{LONG.strip()}\n\nShort."),
    (f"<main><p>{LONG}</p><div class='cookie-notice'>We use cookies</div><p>a\n  <i>b</i><br>c</p></main><aside>side</aside>", f"{LONG.strip()}\n\na b c"),
    (f"<article><header><h1>Head</h1><div>by me</div></header><p>{LONG}</p><form><p>Sign</p></form><footer>f</footer></article>"
     f"<section class=comments><p>{LONG}</p></section>", f"Head\n\n{LONG.strip()}"),
    (f"<nav><ul><li>Menu<article><p>{LONG}</p></article>", LONG.strip()),
    (f"<article><p>{LONG}<script>var a='<p>no</p>'</script><style>p{{}}</style><!-- x --></p><ul><li>one<li>two</ul></article>",
     f"{LONG.strip()}\n\none\n\ntwo"),
    (f"<article class='post comments-open'><p>{LONG}</p></article><article class=comment><p>{LONG}</p></article>", LONG.strip()),
    ("<article></article><footer>only a footer</footer>", ""),
    (f"<div class=wrap><ul class=menu><li><a href=/>Home</a></ul><div class=text><h2>T</h2><p>{LONG}</p><div><p>Hm.</p></div>"
     f"<blockquote>Quote.</blockquote><p>{LONG}</p></div><div class=sidebar><p>{LONG}</p></div><div id=footer>f</div></div>",
     f"T\n\n{LONG.strip()}\n\nHm.\n\nQuote.\n\n{LONG.strip()}"),
    (f"<div><a href=/a>One</a> <a href=/b>Two</a></div><div><p>{LONG}</p><p>See <a href=/c>this</a> too.</p></div>",
     f"{LONG.strip()}\n\nSee this too."),
    (f"<main><article><p>{LONG}</p></article><article><p>Second.</p></article></main>", f"{LONG.strip()}\n\nSecond."),
    ("<article><p>Of.</p></article><div class=ad>Buy many more things than you need today</div>", "Of."),
    (f"<div id=content><h1>T</h1><div class=lead><p>{LONG}</p></div><div class=body>{f'<p>{LONG}</p>' * 9}</div></div>",
     "\n\n".join(["T"] + [LONG.strip()] * 10)),
    (f"<article>{f'<p>{LONG}</p>' * 9}</article><article><p>{LONG}</p></article>", "\n\n".join([LONG.strip()] * 10)),
    (f"<article><div class=article-header><h1>T</h1></div><section class=discussion><p>{LONG}</p></section><p>{LONG}</p><p>a <math>x</math></p></article>",
     f"T\n\n{LONG.strip()}\n\n{LONG.strip()}\n\na x"),
    *[(f"<article><p>{LONG}</p><div class='{name}'><p>{LONG}</p></div><p>End.</p></article>", f"{LONG.strip()}\n\nEnd.") for name in (
        "notice", "related", "tags", "banner", "popup", "social", "subscribe", "breadcrumbs", "discussion", "replies", "comments", "ad")],
    (f"<article><p>Press <button>Start</button> and <label>wait</label> now.</p><p>{LONG}</p><button>Share</button></article>", f"Press Start and wait now.\n\n{LONG.strip()}"),
    (f"<article><p>{LONG}</p></article><!-- never closed <p>no</p>", LONG.strip()),
    (f"<article><p>{LONG}</p><ul><li><a href=/a>One</a><li><a href=/b>Two</a><li><a href=/c>Three</a><li><a href=/d>Four</a><li><a href=/e>Five</a></ul><p>{LONG}</p></article>",
     f"{LONG.strip()}\n\n{LONG.strip()}"),
    (f"<article><p>{LONG}</p><p><a href=/a>A paragraph that is a link, among others that are not.</a></p><p>{LONG}</p></article>",
     f"{LONG.strip()}\n\nA paragraph that is a link, among others that are not.\n\n{LONG.strip()}"),
])
def test_small_pages(page, want):
    assert ht.main_text(page) == want


def test_long_page_whole():
    page = "<article>" + "<p>word word</p>" * 20_000 + "<p>" + "x" * 300_000 + "</p></article>"
    assert len(ht.main_text(page)) == 20_000 * 11 + 300_000


def test_broken_markup_is_linear():
    start = time.perf_counter()
    assert ht.main_text("<div>" * 30_000 + "x" + "</span>" * 30_000) == "x"
    assert ht.main_text("<b>" * 30_000 + "x" + "</p>" * 30_000 + "</li>" * 1000) == "x"
    assert time.perf_counter() - start < 10


@pytest.mark.parametrize("page", [
    "<b>" * 20_000 + "<li>x</li>" * 20_000, "<b>" * 20_000 + "<article>x</article>" * 20_000, "<nav>" * 20_000 + "<article>x" * 20_000,
    "<p>a</p><!-- " + "<p>x</p>" * 1_000_000, "<p>a</p><script>" + "<p>x</p>" * 1_000_000, "<p><b>" * 20_000 + "</p>" * 20_000,
    "<table><tr>" + "<td><i>x" * 20_000, "<dl>" + "<dt><div>x" * 20_000])
def test_hostile_pages_are_linear(page):
    start = time.perf_counter()
    text = ht.main_text(page)
    assert time.perf_counter() - start < 6 and "<" not in text


def test_smoothing_decides(monkeypatch):
    """Without the Gaussian a paragraph that is one link is taken for a menu."""
    page = f"<article><p>{LONG}</p><p><a href=/a>Read on</a></p><p>{LONG}</p></article>"
    assert "Read on" in ht.main_text(page)
    monkeypatch.setattr(ht, "smoothed", lambda ratios, sigma=0: list(ratios))
    assert "Read on" not in ht.main_text(page)


def test_smoothing_keeps_a_constant():
    assert ht.smoothed([3.0] * 7) == pytest.approx([3.0] * 7)


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (1, None, None, "x"), (None, "u", "<p>a</p>", "y")], "page_id long, url string, html string, text string")
    got = ht.extracted(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((str(r[0]), str(r[1]), r[2], r[3]) for r in got.collect()) == [("1", "None", "", 0), ("1", "None", "", 0), ("None", "u", "a", 1)]
    assert ht.extracted(pages.where("false")).count() == 0
