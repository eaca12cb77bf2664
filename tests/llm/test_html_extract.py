import re
import time
from html import unescape

import pytest

from filingpanel.llm import html_extract

SCHEMA = "page_id long, url string, html string, text string, host string"  # the last two clash with names of the operator
LONG = "The quick brown fox jumps over the lazy dog and runs through the wood until the evening. "
FULL = f"""<!DOCTYPE html><html><head><title>Not this</title><style>p {{}}</style><script>var a = "<p>no</p>";</script></head>
<body class="page-with-comments"><!-- <p>hidden</p> -->
<header class="site-header"><a href="/">Home</a><p>Welcome to the site</p></header>
<nav><ul><li><a href="/a">Menu one</a><li><a href="/b">Menu two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies.</p></div>
<div class="content post-4711"><h1>A &amp; B&nbsp;title</h1><p class="lead">First 
 paragraph <b>bold</b>ly  put.<br>New line.<p>Unclosed {LONG * 3}</p>
<div class="ad">Buy now!</div><form action="/x"><label>Name</label><input name="q"><button>Go</button></form>
<ul><li>Point one<li>Point two</ul><table><tr><td>1<td>2</table><blockquote>Said &lt;so&gt;</blockquote></div>
<aside><p>{LONG}</p></aside><section id="comments"><p>{LONG * 9}</p></section>
<footer>&copy; nobody</footer>"""
WANT = "\n".join(["A & B title", "First paragraph boldly put. New line.", "Unclosed " + (LONG * 3).strip(), "Point one", "Point two", "1", "2", "Said <so>"])


def own(page, paths=None):
    return html_extract.extract(page, paths)


def test_whole_page():
    assert own(FULL) == WANT
    assert html_extract.vote(FULL)[0] == "div.content.post-#"


@pytest.mark.parametrize("page, want", [
    ("", ""),
    ("just text &amp no tags", "just text & no tags"),
    ("<p>one<p>two</p></div></article>three", "one\ntwo\nthree"),
    ("<article><header><h1>Title</h1></header><p>Text</p><footer>By me</footer></article>", "Title\nText"),
    ("<article><h1>T</h1><p>a</p><div class='comment-list'><p>reply</p></div></article>", "T\na"),
    ("<article><p>x<p class='advert'>buy<p>y</article>", "x\ny"),
    ("<article><p>a > b & c < d <3</p></article>", "a > b & c < d <3"),
    ("<article><p title='a > b' data-x=\"<p>\">q</p></article>", "q"),
    ("<article><p>a<!-- x --> b<!-- <p>never closed", "a b"),
    ("<article><p>kept<script>if (a < b) { document.write('</p>') }", "kept"),
    ("<article><p>a</p><div hidden><p>b</p></div><div style='display: none'>c</div></article>", "a"),
    ("<form id=f><div><h1>All in a form</h1><p>" + LONG + "</p></div></form>", "All in a form\n" + LONG.strip()),
    ("<article>x&#8217;s &eacute;t&eacute; &unknown; &#x1F600;</article>", "x’s été &unknown; 😀"),
    ("<div><section><p>" + LONG + "</p></section><section><p>" + LONG + "</p></section></div>", LONG.strip() + "\n" + LONG.strip()),
    ("<body><article class=story><p>a</p></article><article class=comment><p>" + LONG + "</p></article>", "a"),
    ("<table><tr><td><a href=x>Menu</a><td><p>" + LONG + "</p></table>", LONG.strip()),
    ("<article><p>a</p>\x00﻿</article", "a\n\x00﻿"),
])
def test_single_pages(page, want):
    assert own(page) == want


def test_host_decides(spark):
    """A page with a long unmarked list beside a short article follows the other pages of its host."""
    def page(i, article, other):
        return f"<div class='left'><p>{other}</p></div><div class='story-{i}'><h1>Title {i}</h1><p>{article}</p></div>"

    odd = page(9, "Short.", LONG * 5)
    rows = [(i, "http://one.example.org/" + str(i), page(i, LONG * 4, "Hi."), "t", "h") for i in range(8)]
    rows += [(9, "https://u:p@ONE.example.org:80/9", odd, "t", "h"), (10, "http://two.example.org/", odd, "t", "h"), (11, None, odd, "t", "h"),
             (12, "no address", None, "t", "h"), (13, "http://two.example.org", "", "t", "h"), (None, "http://one.example.org/x", odd, "t", "h")]
    rows += rows[:1]
    got = html_extract.main_text(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    text = {r.page_id: r.text for r in got}
    assert text[9] == text[None] == "Title 9\nShort."
    assert text[0] == "Title 0\n" + (LONG * 4).strip()
    assert text[10] == text[11] == (LONG * 5).strip()  # alone, such a page can only go by itself
    assert text[12] == text[13] == ""
    assert html_extract.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_paths_of_a_host(spark):
    pages = [("http://h/%d" % i, f"<main><p>{LONG}</p></main>") for i in range(12)] + [("http://h/x%d" % i, f"<div class=a{i}><p>{LONG}</p></div>") for i in range(3)]
    pages += [("http://h/y", f"<section><p>{LONG}</p></section>"), ("http://empty/", ""), (None, "<p>x</p>")]
    got = html_extract.host_paths(spark.createDataFrame(pages, "url string, html string")).collect()
    assert [(r.host, r.paths) for r in got] == [("h", ["main", "div.a#"])]


def plain(page):
    """The pages of the tables have an element article of headings and paragraphs, with inline tags inside."""
    inner = re.search("<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:h1|p)>", inner)]
    return "\n".join(filter(None, blocks))


def test_table_against_plain_search(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: (r.url, plain(r.html)) for r in pages.collect()}
    got = html_extract.main_text(pages).collect()
    assert len(got) == len(want) and all((r.url, r.text) == want[r.page_id] for r in got)


def test_odd_markup_takes_no_quadratic_time():
    for piece in ("<", "<a \"", "<!--", "</", "<div ", "&", "<div>", "<div>x", "</div>", "<li>", "<ul><li>", "<p class='ad'>", "a='<", "<header>h", "</p>"):
        began = time.process_time()
        own(piece * 20000)
        assert time.process_time() - began < 5, piece
