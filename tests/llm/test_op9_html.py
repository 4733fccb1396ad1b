import time

import pytest

from tessera.llm import op9_html
from tessera.llm.op9_html import extract

LONG = "Some prose, with commas, that goes on for quite a while so that it counts as a paragraph of its own. "


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("<html><body></body></html>", ""), ("plain &lt;text&gt;", "plain <text>"),
    ("<p>a&nbsp;b\n c<br>d</p><p>e", "a b c d e"), ("<ul><li>x<li>y</ul>", "x y"), ("<p>one<!-- no --><script>var a='</p>'</script> two", "one two"),
    ("<div>unclosed <b>bold <div>inner", "unclosed bold inner"), ("<p>5 < 6 &amp; 7 > 3</p>", "5 < 6 & 7 > 3"),
])
def test_small_pages(page, want):
    assert extract(page) == want


@pytest.mark.parametrize("wrap", ["<article>{}</article>", '<div id="content">{}</div>', "<main><div>{}</div></main>", '<table><tr><td class="body">{}</td></tr></table>'])
def test_article_without_surroundings(wrap):
    body = f"<h1>Title</h1><p>{LONG}</p><p><b>short.<br><p>{LONG}</p><form><p>sign up</p></form>"
    around = '<header><a href="/">Site</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad">Buy, buy, buy this thing now, it is cheap</div>'
    after = f'<aside class="sidebar">{LONG}</aside><div id="comments"><p>{LONG * 3}</p></div><div class="cookie-notice">We use cookies</div><footer>&copy; x</footer>'
    want = " ".join(f"Title {LONG} short. {LONG}".split())
    assert extract(f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{around}{wrap.format(body)}{after}</body></html>") == want


@pytest.mark.parametrize("intro", ['<div class="intro">{}</div>', '<div class="row"><div class="col">{}</div></div>'])
def test_short_siblings_stay(intro):
    first = f"<p>{LONG * 4}</p>"
    links = '<div class="list"><ul><li><a href="/a">One page</a><li><a href="/b">Another page</a></ul></div>'
    rest = '<h2><a href="#s">Sub</a></h2>bare <a href="/c">text</a> that goes on here<pre>x = 1</pre><blockquote>Short.</blockquote><div class="more"><p>Short end.</p></div>'
    want = " ".join(f"{LONG * 4} Sub bare text that goes on here x = 1 Short. Short end.".split())
    assert extract(f'<body><div id="post">{intro.format(first)}{rest}</div>{links}</body>') == want
    assert extract(f'<body>{links}<div id="post">{intro.format(first)}{links}{rest}</div></body>') == want


WRAPPERS = [
    '<div class="page has-sidebar">{}</div>', '<div class="post no-comments">{}</div>', '<div class="side-by-side">{}</div>', "<form action=/x>{}</form>", "<div title=it's>{}</div>", '<div title="5" wide">{}</div>',
    '<div class="with-footer"><div class="menu-open">{}</div></div>', '<body class="modal-ready notice">{}</body>', '<section id="search-result">{}</section>', '<div data-x="a > b">{}</div>', "<div class=content>{}",
    '<div class="nav-wrapper"><div>{}</div></div>', '<aside>{}</aside>', '<div style="display:none">{}</div>', "<center><font>{}</font></center>", "<DIV CLASS='Content'>{}</DIV>",
]
AROUND = [
    '<div class="comments"><p>{}</p></div>', '<div id="sidebar"><p>{}</p></div>', "<footer><p>{}</p></footer>", "<nav><p>{}</p></nav>", '<div class="cookie-notice">{}</div>', '<div class="ad-banner"><p>{}</p></div>',
    "<form><label>{}</label><p>{}</p></form>", '<ol class="commentlist"><li class="comment"><p>{}</p></li></ol>', "<script>{}</script>", "<style>{}</style>", '<p hidden>{}</p>', "<!-- {} -->", '<ul class="related"><li><a href="/">{}</a></li></ul>',
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_wrappers_say_nothing(wrapper):
    """Whatever the element around all is called, the article comes out, and only it."""
    body = f"<p>{LONG * 4}</p><h2>Sub</h2><p>{LONG * 3}</p>"
    want = " ".join(f"{LONG * 4} Sub {LONG * 3}".split())
    assert extract(wrapper.format(body)) == want
    assert extract(f"<html>{wrapper.format('<article>' + body + '</article>')}</html>") == want


@pytest.mark.parametrize("around", AROUND)
def test_surroundings_go(around):
    body = f"<p>{LONG * 4}</p><p>{LONG * 3}</p>"
    want, other = " ".join(f"{LONG * 4} {LONG * 3}".split()), "Other words, of which there are some here."
    for page in (f'<div class="post">{body}</div>{around.replace("{}", other)}', f'{around.replace("{}", other)}<article>{body}</article>', f'<div class="has-sidebar">{around.replace("{}", other)}<div>{body}{around.replace("{}", other)}</div></div>'):
        assert extract(f"<html><body>{page}</body></html>") == want


def test_long_comments_are_not_the_article():
    body, comments = f"<p>{LONG * 4}</p><p>{LONG * 3}</p>", "".join(f'<div class="comment"><p>{LONG * 2}</p></div>' for _ in range(8))
    assert extract(f'<div class="post">{body}</div><div id="comments">{comments}</div>') == " ".join(f"{LONG * 4} {LONG * 3}".split())


@pytest.mark.parametrize("page, want", [
    ("<p a='1' b=2 c>x</p>", "x"), ("<p a=>x</p>", "x"), ("<p =a>x</p>", "x"), ("<p/a>x</p>", "x"), ("a < b <3 c", "a < b <3 c"), ("x<", "x<"), ("x</", "x</"), ("x</>y", "xy"),
    ("<!-->x", "x"), ("<!--->x", "x"), ("<!doctype html>x<?php y ?>z", "xz"), ("x<a href='y", "x"), ("<![CDATA[x]]>y", "y"), ("<p>x</div></p>y", "x y"), ("<script>a</scripty>b</script >c", "c"), ("<textarea>a<p>b</textarea>c", "c"),
])
def test_markup_as_the_standard_reads_it(page, want):
    assert extract(page) == want


@pytest.mark.parametrize("page", ["<div class=x>" * 20_000, "<a '" * 20_000, "<a b='" * 20_000, "</x>" * 50_000, "<b>" * 20_000 + "<hr>" * 20_000, "<" * 50_000, "<!--" * 20_000, "<p a=" * 20_000, "<li>" * 20_000 + "</ul>" * 20_000, "<script>" * 9_000])
def test_time_is_linear(page):
    took = []
    for times in (1, 4):
        began = time.process_time()
        extract(page * times)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5


def test_very_long_and_deep():
    assert len(extract("<div>" * 5000 + LONG)) == len(LONG) - 1
    assert len(extract("<p>" + "word " * 200_000).split()) == 200_000


def test_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = op9_html.op9_html(spark, sf_dir).collect()
    assert len(got) == pages.count() and all(r["n_chars"] == len(r["text"]) > 0 for r in got)
    odd = spark.createDataFrame([(None, None, None, "t"), (1, "u", "<p>x", "t"), (1, "u", "<p>x", "t")], "page_id long, url string, html string, text string")
    assert sorted(r["text"] for r in op9_html.extract_pages(odd).collect()) == ["", "x", "x"]
    assert op9_html.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
