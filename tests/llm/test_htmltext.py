"""Main text of pages against the articles that the given pages hold, and small cases."""

import os
import re
from html import unescape

import pytest

from loamlog.llm import htmltext, registry
from loamlog.llm.common import read_table

LONG = "This sentence is long enough to be a paragraph of some article, with words and more words in it."


def test_line_blocks():
    assert htmltext.line_blocks([0, 0, 0]) == []
    assert htmltext.line_blocks([]) == []
    assert htmltext.line_blocks([0, 100, 0, 0, 0, 0, 90, 0], 3, 86) == [(1, 2), (6, 7)]
    assert htmltext.line_blocks([1, 0, 5, 0], 2, 86) == [(2, 3)]


CASES = [
    (None, ""),
    ("", ""),
    ("<html><body></body></html>", ""),
    ("just text", "just text"),
    (f"<nav><a href=x>{LONG}</a></nav><p>{LONG}</p><footer>{LONG}</footer>", LONG),
    (f"<article><h1>A &amp; B</h1><p>{LONG}<p>x&nbsp;\n  y</article><div class='comments'><p>{LONG}</p></div>", f"A & B\n{LONG}\nx y"),
    (f"<p>{LONG}</p><script>if (a < b) '</p>'</script><style>p{{}}</style><!-- <p>no</p> -->", LONG),
    (f"<div class=cookie-notice>{LONG}</div><main><p>{LONG} 1 &lt; 2</p></main><aside>{LONG}</aside>", f"{LONG} 1 < 2"),
    (f"<form><input value='>'><button>Send</button></form><p>{LONG}</p><p>a < b</p>", f"{LONG}\na < b"),
    ("<article><p>one</p><p>two</p></article>", "one\ntwo"),
    ("<p>unclosed <b>bold", "unclosed bold"),
]


@pytest.mark.parametrize("html, expected", CASES)
def test_main_text(html, expected):
    got = htmltext.main_text(html)
    assert got == expected


def test_long_page_is_read_whole():
    html = "<article>" + "".join(f"<p>{i} {LONG}</p>" for i in range(20_000)) + "</article>"
    assert htmltext.main_text(html).count("\n") == 19_999


@pytest.mark.parametrize("html", ["<" * 50_000, "<a " * 20_000, "<p class='" * 20_000, "<p class='>" * 20_001, "<div>" * 50_000, "&" * 50_000, "<!--" * 20_000, "<script>" * 20_000])
def test_odd_pages_end(html):
    assert isinstance(htmltext.main_text(html), str)


def test_rows_and_columns(spark):
    rows = [(i, html, "n", "z") for i, (html, _) in enumerate(CASES)] + [(None, LONG, None, None), (3, "just text", "n", "z")]
    frame = spark.createDataFrame(rows, "page_id long, html string, TEXT string, url string")
    found = htmltext.extract_text(frame)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    texts = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in found.collect())
    expected = [(str(i), t, len(t)) for i, (_, t) in enumerate(CASES)] + [("None", LONG, len(LONG)), ("3", "just text", 9)]
    assert texts == sorted(expected)
    assert htmltext.extract_text(frame.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="given tables are absent")
def test_given_pages_with_an_article(spark):
    """Where a page holds plain paragraphs in one article, its text is that article's."""
    pages = {r["page_id"]: r["html"] for r in read_table(spark, "/root/testdata/sf0.01", "pages").collect()}
    found = {r["page_id"]: r for r in registry.queries()["op13_html_text"](spark, "/root/testdata/sf0.01").collect()}
    assert found.keys() == pages.keys()
    checked = 0
    for page_id, html in pages.items():
        inside = re.findall(r"<article>(.*?)</article>", html, re.S)
        if len(inside) != 1 or re.search(r"<(?!/?(?:h1|p|b|br)\b)[a-z!/]", inside[0]):
            continue
        blocks = re.split(r"</?(?:h1|p)>", re.sub(r"</?b>", "", inside[0].replace("<br>", " ")))
        blocks = [" ".join(unescape(b).split()) for b in blocks]
        assert found[page_id]["text"] == "\n".join(b for b in blocks if b)
        checked += 1
    assert checked > len(pages) // 2
