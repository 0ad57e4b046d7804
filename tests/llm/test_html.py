import pytest

from furrow.llm import html

CASES = [
    ("<nav><a href='/'>Home</a></nav><article><h1>T &amp; u</h1><p>One  two\n three.<p>Four <b>five</b>.</article><footer>&copy;</footer>", "T & u\nOne two three.\nFour five."),
    ("<script>var a='<p>x</p>'</script><style>p{}</style><body><header>Site</header><main><p>A.</p><div class='ad'>Buy</div><p>B &lt;p&gt; c&nbsp;d</p></main>", "A.\nB <p> c d"),
    ("<article><p>Text.</p><aside>Side</aside><section class='comments'><p>me too</p><p>and me</p><p>x</p></section><p>End.</p></article>", "Text.\nEnd."),
    ("<div id='sidebar'>a b</div><div class='post'><p>No landmarks here.</p><p>Short.</p></div><div class='cookie-notice'>ok?</div>", "No landmarks here.\nShort."),
    ("<article><header><h1>Kept</h1></header><p>Body<form><input>Mail</form></p><!-- no <p>x</p> --><ul><li>i<li>ii</ul></article>", "Kept\nBody\ni\nii"),
    ("<article><p title='a > b'>Cut off &am", "Cut off &am"),
    ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
    ("", ""), (None, ""), ("plain", "plain"), ("<nav>only</nav>", ""), ("<p>" * 3000 + "deep", "deep"), ("<b>" * 9000 + "x" * 300_000, "x" * 300_000),
]


@pytest.mark.parametrize("page,text", CASES)
def test_cases(page, text):
    assert html.main_text(page) == text


def test_frame_keeps_rows_and_columns(spark):
    rows = [(1, "u", "<p>a</p>", "old"), (1, "u", "<p>a</p>", "old"), (None, None, None, None)]
    df = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert sorted((r.page_id or 0, r.text) for r in df.collect()) == [(0, ""), (1, "a"), (1, "a")]
    assert html.extract(spark.createDataFrame([], "html string")).collect() == []


def test_article_of_every_page(spark):
    import re
    from html import unescape

    from conftest import SMALL
    from furrow.llm.queries import QUERIES

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = QUERIES["op4_html"](spark, SMALL).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = (" ".join(unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


LINKED = [
    ("<article><h1><a href=x>Title</a></h1><p>Body</p></article>", "Title\nBody"),
    ("<article><p>Body.</p><ol><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a><li><a href=4>Four</a></ol><p>End.</p></article>", "Body.\nOne\nTwo\nThree\nFour\nEnd."),
    ("<main><p><a href=1>a</a></p><p><a href=2>b</a></p><p><a href=3>c</a></p><p><a href=4>d</a></p></main>", "a\nb\nc\nd"),
    ("<ul><li><a href=1>Home page of the site</a><li><a href=2>Next</a><li><a href=3>x</a></ul><article><p>B <a href=4>c</a></p></article>", "B c"),
]


@pytest.mark.parametrize("page,text", LINKED)
def test_links_of_an_article_stay(page, text):
    assert html.main_text(page) == text


OUTERMOST = [
    ("<main><h1>Title</h1><article><p>One.</p><p>Two.</p></article></main>", "Title\nOne.\nTwo."),
    ("<article><p>Lead</p><article class=quote><p>Quoted words</p></article><p>End</p></article>", "Lead\nQuoted words\nEnd"),
    ("<article><p>x</p></article><div class='box'>longer text</div>", "x"),
    ("<main><p>Text.</p><div class='adBox'>Buy now</div><p>End.</p></main>", "Text.\nEnd."),
    ("<main><article><p>First.</p></article><article><p>Second.</p></article></main>", "First.\nSecond."),
    ("<article><p>short</p></article><article><p>the longer one</p></article>", "the longer one"),
    ("<article></article><div><p>Only text outside.</p></div>", "Only text outside."),
]


@pytest.mark.parametrize("page,text", OUTERMOST)
def test_outermost_article_is_kept_whole(page, text):
    assert html.main_text(page) == text
