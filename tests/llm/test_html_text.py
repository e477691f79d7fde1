import html
import re

import pytest

from holdfast.llm.html_text import extract, main_text

LONG = "This is the first paragraph of the article and it is long enough to be decided by the rules of the pass, as it has a lot of the stop words in it and more."
MORE = "And the second paragraph of the text, which <a href=z>links</a> to a page that is about the same thing, is fine for the reader of this page to have."
PLAIN_MORE = re.sub("<[^>]*>", "", MORE)


def test_container_free_page():
    page = f"""<html><body class="no-sidebar"><div id="header">Name and slogan of the site</div><div class="cookie-notice"><p>We use cookies for the ads on this site and for the rest.</p></div>
    <ul><li><a href=x>Home</a><li><a href=y>About</a></ul><div><h2>The title</h2><p>{LONG}</p><p>Short one.</p><p>{MORE}</p>
    <div class="comments"><p>{LONG}</p></div></div><form><p>{LONG}</p></form><footer>{LONG}</footer></body></html>"""
    assert main_text(page) == f"The title\n\n{LONG}\n\nShort one.\n\n{PLAIN_MORE}"


def test_article_with_everything_around_it():
    page = f"""<!DOCTYPE html><head><title>T</title><script>var t="</p>";</script><style>p{{}}</style></head><body><header><p>{LONG}</p></header><nav><a>{LONG}</a></nav>
    <aside>{LONG}</aside><main><article><header><h1>Head &amp; line</h1></header><div class="share">Share this</div><p>Tiny.<p>One<br>two&nbsp;&nbsp;three <b>bold</b>ly &lt;i&gt;</p><!-- <p>no</p> -->
    <section id="comments"><p>{LONG}</p></section><noscript>{LONG}</noscript><div style="display: none">{LONG}</div></article></main><div class="ad">{LONG}</div><p>{LONG}</p></body>"""
    assert main_text(page) == "Head & line\n\nTiny.\n\nOne two three boldly <i>"


@pytest.mark.parametrize("page,text", [
    ("", ""), ("<html></html>", ""), ("<p", ""), (f"<article><p>{LONG}</p><foot", LONG), ("<article><p>a &am", "a &am"), ("<article><p>a &amp", "a &"),
    ("<article><p title='a > b'>x < y</p></article>", "x < y"), ("<article><p>a<script>if (1 < 2) '</p>'</script>b</article>", "a\n\nb"), ("<article><p>open <a href=\"x>y</p>", "open y"),
])
def test_odd_markup(page, text):
    assert main_text(page) == text


LONGER = f"{LONG} {LONG}"
BARE = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore"


@pytest.mark.parametrize("page,text", [
    (f"<div class=main-image><p>caption</p></div><div id=text><p>{LONG}</p><p>{LONGER}</p></div>", f"caption\n\n{LONG}\n\n{LONGER}"),
    (f"<article><p>A card.</p></article><div id=text><h2>Title</h2><p>{LONGER}</p><p>{LONG}</p></div>", f"A card.\n\nTitle\n\n{LONGER}\n\n{LONG}"),
    (f"<div class='layout sidebar-right'><article><p>{LONG}</p></article><div class=sidebar>{LONGER}</div></div>", LONG),
    (f"<div class='layout sidebar-right'><p>{LONGER}</p><div class=sidebar>{LONGER}</div></div>", LONGER),
    (f"<form id=aspnet><nav>{LONGER}</nav><div><p>{LONGER}</p></div></form>", LONGER),
    (f"<form><main><p>{LONG}</p></main></form><div id=comments><article>{LONGER}</article></div>", LONG),
    (f"<article><p>{LONG}</p><ul><li><a href=x>{LONG}</a><li>{BARE}<li><a href=y>{LONG}</a></ul></article>", LONG),
])
def test_rules_decide_and_containers_hint(page, text):
    assert main_text(page) == text


RUSSIAN = "Эта страница рассказывает о том, как устроены поисковые роботы, и почему они читают одни документы чаще других. " * 3


@pytest.mark.parametrize("page,text", [
    (f"<article class='post category-social'><p>{LONGER}</p></article>", LONGER),
    (f"<article class='post tags-news'><p>{LONGER}</p></article>", LONGER),
    (f"<article class='related-post'><p>{LONGER}</p></article>", LONGER),
    (f"<div class='share-story main'><p>{LONGER}</p></div><nav>{LONGER}</nav>", LONGER),
    (f"<article><p>{LONG}</p></article><div class='related'><article class='related-post'><p>{LONGER}</p></article></div>", LONG),
    (f"<article><p>{LONG}</p></article><article class='comment'><p>{LONGER}</p></article>", LONG),
    (f"<div><p>{RUSSIAN}</p></div><ul><li><a href=x>{RUSSIAN}</a></ul><footer>{RUSSIAN}</footer>", RUSSIAN.strip()),
    (f"<p>{LONGER}<button>Press<p>{LONG}</p>", f"{LONGER}\n\n{LONG}"),
    (f"<div><svg><path><p>{LONGER}</p></div>", LONGER), (f"<div><select><option>a<p>{LONGER}</p></div>", f"{LONGER}"),
    (f"<p>{LONGER}</p><script>var x = '<p>{LONG}</p>'", LONGER),
])
def test_names_languages_and_missing_end_tags(page, text):
    assert main_text(page) == text


def test_long_page_is_whole():
    body = "".join(f"<p>{LONG} {i}</p>" for i in range(5000))
    assert main_text(f"<body><article>{body}</article></body>").count("\n\n") == 4999


def test_pages_of_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    got = {r["page_id"]: r for r in extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect()}
    assert len(got) == len(rows)
    for r in rows:
        m = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", r["html"], re.S)
        parts = re.split(r"</?(?:p|h1)>|<br>(?=<p>)", m[1]) if m else []
        want = "\n\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*(>|\Z)", "", p)).split()) for p in parts) if x)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_tables(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars int"
    got = extract(spark.createDataFrame([(1, "u", None, "x", 5), (1, "u", "", "x", 5), (None, None, f"<article><p>{LONG}</article>", None, None)], schema))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "u", "", 0), (1, "u", "", 0), (None, None, LONG, len(LONG))], key=repr)
    assert extract(spark.createDataFrame([], schema)).count() == 0
