"""HTML extraction: whole pages worked out by hand, and the given pages by their template."""

import html
import re
import time

import pytest

from epispark.llm import workload
from epispark.llm.pages import extract_text, main_text

LONG = "Words, and more words, that go on for a while so that this reads as a paragraph of some length, truly."

PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p {{}}</style></head><body>
<header class="top"><h1>Site</h1><a href="/">Home</a></header>
<nav><ul><li><a href="/a">Menu one</a></li></ul></nav>
<div class="cookie-notice"><p>{LONG}</p></div>
<div id="wrap"><aside><p>{LONG} side</p></aside><div class="sidebar"><p>{LONG} bar</p></div>
<article><header><h1>Title &amp; more</h1></header><p>First &lt;b&gt; {LONG}<p>Second <b>bold<br>line</b> {LONG}
<ul><li>one<li>two</ul><script>var x = "<p>no</p>";</script><form><p>{LONG}</p><input name=q></form>
<div class="ad-slot">Buy {LONG}</div><blockquote>Quote</blockquote>tail
<section class="comments"><p>{LONG} reader</p></section></article></div>
<div id="disqus_thread"><p>{LONG} reply</p></div><footer><p>{LONG} foot</p></footer></body></html>"""


def test_a_page_with_everything_around_its_article():
    assert main_text(PAGE).split("\n\n") == [
        "Title & more", f"First <b> {LONG}", f"Second bold line {LONG}", "one", "two", "Quote", "tail"]


def test_no_article_element():
    page = (f"<body><div class=links><a href=1>{LONG}</a> <a href=2>{LONG}</a></div><div><div class=content>"
            f"<h2>Head</h2><p>{LONG}</p><div>{LONG} in a div</div><p>{LONG}</p></div><p>aside</p></div>")
    assert main_text(page).split("\n\n") == ["Head", LONG, f"{LONG} in a div", LONG]


def test_siblings_of_the_best_container():
    part = f"<div><p>{LONG}</p><p>{LONG}</p></div>"
    page = f"<body><div>{part}{part}<p>{LONG}</p><p>short</p><div><a href=x>{LONG}</a></div></div></body>"
    assert main_text(page).split("\n\n") == [LONG] * 5 + ["short"]
    apart = f"<body><div>{part}<hr></div><div>{part * 3}</div><div><p>note</p></div><p>{LONG}</p></body>"
    assert main_text(apart).split("\n\n") == [LONG] * 9


def test_an_article_inside_what_is_named_after_a_sidebar():
    page = f"<body><nav>menu</nav><div class='wrap has-sidebar'><article><p>{LONG}</p></article></div></body>"
    assert main_text(page) == LONG
    assert main_text(f"<body><div class='sidebar'><p>{LONG}</p></div></body>") == ""


def test_odd_input():
    assert main_text("plain text &eacute;\n only") == "plain text é only"
    assert main_text("<p>a&nbsp; b &#x41;&unknown; &amp") == "a b A&unknown; &"
    for page in ("", "<", "<!-- x", "<p", "</p></div>", "<script>x", "<nav><p>menu</p></nav>", "<!DOCTYPE html>", "<p> </p>"):
        assert main_text(page) in ("", "<", "<p", "<!-- x")
    assert main_text("<div>" * 20_000 + "deep") == "deep"
    assert main_text("<p>" + "word " * 200_000) == ("word " * 200_000).strip()
    assert main_text("<article><p>cut off in the <b>mid") == "cut off in the mid"


def test_given_pages_by_their_template(spark):
    folder = "/root/testdata/sf0.01"
    rows = workload.QUERIES["op1_html_text"](spark, folder)
    assert rows.columns == ["page_id", "url", "text", "n_chars"]
    found = {r.page_id: r for r in rows.collect()}
    for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
        inner = r.html.split("<article>")[1].split("</article>")[0]
        blocks = [
            " ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split())
            for b in re.split(r"</?(?:p|h1)>", inner)
        ]
        expected = "\n\n".join(b for b in blocks if b)
        assert (found[r.page_id].text, found[r.page_id].n_chars) == (expected, len(expected))


def test_columns_and_nulls(spark):
    pages = spark.createDataFrame(
        [(1, None, None, 5), (1, None, None, 5), (None, "u", f"<p>{LONG}</p>", 6), (3, "u", "", 7)],
        "page_id long, url string, html string, n_chars int")
    out = extract_text(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in out.collect()) == [
        (0, LONG, len(LONG)), (1, "", 0), (1, "", 0), (3, "", 0)]
    assert extract_text(pages.limit(0)).count() == 0


def test_names_do_not_take_the_article_away():
    foot = "<p>(c) 2024</p>"
    for name in ("wrap has-sidebar", "wrap sidebar-left", "widget", "post comments-open", "related", "tags"):
        assert main_text(f"<div class='{name}'><article><p>{LONG}</p></article></div>{foot}") == LONG, name
        assert main_text(f"<article class='{name}'><p>{LONG}</p></article><div>{foot}</div>").split("\n\n")[0] == LONG, name
        assert main_text(f"<div class='{name}'><p>{LONG}</p><p>{LONG}</p></div>{foot}").split("\n\n")[:2] == [LONG] * 2, name
    for name in ("content no-sidebar", "post comments-open", "content has-sidebar", "overflow-hidden", "md:hidden", "widget"):
        assert main_text(f"<div class='{name}'><p>{LONG}</p></div>") == LONG, name


def test_names_still_leave_out_what_is_beside_the_article():
    thread = "".join(f"<li class='comment'><p>{LONG} {k}</p></li>" for k in range(8))
    page = f"<body><div class='wrap'><div class='content'><p>{LONG}</p><p>{LONG}</p></div><ol class='comments'>{thread}</ol></div></body>"
    assert main_text(page) == f"{LONG}\n\n{LONG}"
    page = f"<body><div class='content'><p>{LONG}</p></div><div class='sidebar'><p>{LONG} bar</p></div></body>"
    assert main_text(page) == LONG


def test_a_list_of_sources_in_the_article_stays():
    sources = "<ul><li><a href=1>One source</a></li><li><a href=2>Another source</a></li></ul>"
    for tag in ("article", "main"):
        assert main_text(f"<{tag}><p>{LONG}</p>{sources}</{tag}>").split("\n\n") == [LONG, "One source", "Another source"]
    assert main_text(f"<body><div><p>{LONG}</p>{sources}</div></body>") == LONG


@pytest.mark.parametrize("html", [
    "<div>" * 50_000 + "</section>" * 50_000, "<b>" * 50_000 + "x</div>" * 50_000, "<b><td>" + "<i>" * 80_000 + "</b>" * 80_000,
    "<header>" * 100_000, "<li><div>" + "<b>" * 50_000 + "<li></b>" * 30_000,
])
def test_unbalanced_markup_takes_time_in_proportion(html):
    started = time.process_time()
    main_text(html)
    assert time.process_time() - started < 4  # minutes, if every end tag were searched for


def test_a_column_named_like_an_inner_one(spark):
    pages = spark.createDataFrame([(1, "<p>a</p>", "kept", "x")], "page_id long, html string, _html string, text string")
    assert [tuple(r) for r in extract_text(pages).collect()] == [(1, "kept", "a", 1)]


def test_a_headline_beside_its_container():
    text = "A long paragraph of plain words, with a comma, and more of them than a menu has. " * 3
    body = f"<div id=content><p>{text}</p><p>{text}</p></div>"
    said = f"{text.strip()}\n\n{text.strip()}"
    for page in (f"<h1>Title</h1>{body}", f"<div class=page><h1>Title</h1><div>{body}</div></div>"):
        assert main_text(page) == f"Title\n\n{said}"
    for page in (
        f"<h1><a href=/>Site</a></h1>{body}", f"<header><h1>Site</h1></header>{body}", f"<h1 class=banner>Site</h1>{body}",
        f"<div><h1>Other</h1></div>{body}", f"{body}<h1>Later</h1>", f"<h1>One</h1><h1>Two</h1>{body}",
    ):
        assert main_text(page) == said, page
    own = body.replace("<p>", "<h1>Own</h1><p>", 1)
    assert main_text(f"<h1>Site</h1>{own}") == f"Own\n\n{said}"


def test_a_headline_is_found_in_time_in_proportion():
    began = time.perf_counter()
    main_text("<h1>Title</h1>" + "<div>" * 50_000 + "<p>" + "words, " * 50 + "</p>")
    assert time.perf_counter() - began < 5
