import time

import pytest

from quillform.llm import extract, q_extract

LONG = "The harbour town, quiet in winter, fills with visitors, boats and stalls as soon as the first warm week of spring has come."


def page(body: str, head: str = "") -> str:
    return f"<!DOCTYPE html><html><head><title>Title, of, the, page</title>{head}</head><body>{body}</body></html>"


def text(body: str) -> str:
    return extract.main_text(page(body))[0]


FURNITURE = (
    '<header><h1>Site name</h1><p>Slogan, of, the, site, that, is, long</p></header><nav><ul><li><a href="/">Home</a></li><li>Menu</li></ul></nav>'
    f'<div class="cookie-banner" role="dialog"><p>{LONG} We use cookies.</p></div><div id="sidebar-left"><h3>Side</h3><p>{LONG} Side.</p></div><aside><p>{LONG} Aside.</p></aside>'
)
TAIL = (
    f'<section id="comments"><h2>3 comments</h2><article class="comment-body"><p>{LONG} First!</p></article><article class="comment-body"><p>{LONG} {LONG} Second!</p></article></section>'
    f'<form action="/s"><label>Search</label><input name="q"><textarea>{LONG}</textarea><button>Go</button></form><div class="related"><a href="/1">One</a><a href="/2">Two</a></div><footer><p>{LONG} &copy; 2024</p></footer><script>var x = "<p>no</p>";</script>'
)
ARTICLE = f"<h2>Heading</h2><p>{LONG}</p><p>Short.</p><ul><li>one</li><li>two <a href='/x'>linked</a> words</li></ul><p>{LONG} End.</p>"
WANT = f"Heading {LONG} Short. one two linked words {LONG} End."


@pytest.mark.parametrize("box", ["<article>{}</article>", "<main>{}</main>", "<div>{}</div>", '<div class="wrap"><div class="post-content">{}</div></div>', "<div><div><div>{}</div></div></div>", '<form id="aspnet"><article>{}</article></form>'])
def test_furniture_goes_whatever_holds_the_article(box):
    assert text(FURNITURE + box.format(ARTICLE) + TAIL) == WANT


def test_furniture_inside_the_article_goes():
    junk = '<div class="ad">Buy!</div><nav>toc</nav><figure><img src="a"><figcaption>Caption</figcaption></figure><div class="share-bar"><span>Share</span></div><style>p{}</style><span class="sponsored">Paid <span>post</span> here</span><footer>Filed</footer>'
    assert text(f"<article><header><h1>Title</h1></header><p>{LONG}</p>{junk}<p>After.</p></article>") == f"Title {LONG} Caption After."


def test_paragraphs_in_boxes_of_their_own():
    boxes = "".join(f"<div><p>{LONG} {i}</p></div>" for i in range(4))
    assert text(f"{FURNITURE}<div>{boxes}</div>{TAIL}") == " ".join(f"{LONG} {i}" for i in range(4))


def test_a_heading_before_the_container_and_prose_beside_it_are_kept():
    assert text(f"{FURNITURE}<div><h1>Head</h1><div>{ARTICLE}</div><p>{LONG} Beside.</p></div>{TAIL}") == f"Head {WANT} {LONG} Beside."


def test_menus_of_links_lose_to_prose():
    menu = "".join(f"<p><a href='/{i}'>{LONG}</a></p>" for i in range(20))
    assert text(f"<div>{menu}</div><div>{ARTICLE}</div>") == WANT


def test_references_white_space_and_inline_markup():
    got = text("<article><p>a&amp;b &lt;p&gt; &#233;&#xe9;&eacute; x&nbsp;\n\t y<b>bo</b>ld<br>z &am &unknown; 5 < 6 &amp</p><pre>  two\n  lines </pre><table><tr><td>c1<td>c2<tr><td>c3</table></article>")
    assert got == "a&b <p> ééé x ybold z &am &unknown; 5 < 6 & two lines c1 c2 c3"


def test_open_tags_broken_tags_comments_and_quotes():
    assert text("<article><p>one<b>two<p>three<!-- <p>no</p> --><p title='a > b' data-x=\"<p>\">four</q><li>five<li>six") == "onetwo three four five six"
    assert text("<article>before<a href=\"x") == "before"
    assert text("<article>it's <a don't>fine</a> <!-->shown<!--> too <!-- never closed") == "it's fine shown too"
    assert text("<article>a<script>'</article>'</scripty></script >b<textarea><p></textarea>c</article>") == "a b c"


@pytest.mark.parametrize("value", [None, "", " \n ", "<html></html>", "<nav>only a menu</nav>", "<script>x</script>", "<"])
def test_pages_without_an_article(value):
    assert extract.main_text(value)[0] in ("", "<")


def test_plain_text_and_hidden_blocks():
    assert extract.main_text("just words")[0] == "just words"
    assert text("<p hidden>a</p><p style='display: none'>b</p><p aria-hidden=true>c</p><p>seen</p>") == "seen"


def test_work_is_linear_in_length_and_depth():
    began = time.time()
    deep = "<div>" * 50_000 + "<p>" + "word, " * 20_000 + "</p>" + "</div>" * 50_000
    assert extract.main_text(deep)[0].split() == ["word,"] * 20_000
    assert extract.main_text("<p>a, b <" * 50_000)[1]
    assert extract.main_text('<a href="' * 50_000)[0] == ""
    assert extract.main_text("<!--" * 100_000)[0] == ""
    assert extract.main_text("<script>" + "</scrip" * 100_000)[0] == ""
    assert extract.main_text("<i>" * 100_000 + "<li>x" * 20_000)[1] == 20_000
    assert time.time() - began < 20


def test_operator_keeps_columns_and_rows(spark):
    rows = [(1, "x", None), (1, "x", None), (2, None, "<article><p>hi</p></article>"), (None, "y", "")]
    got = extract.extract(spark.createDataFrame(rows, "text int, score string, html string")).collect()
    assert sorted((r.page.text or 0, r.page.score or "", r.text, r.n_blocks) for r in got) == [(0, "y", "", 0), (1, "x", "", 0), (1, "x", "", 0), (2, "", "hi", 1)]


def test_query_on_hostile_and_empty_tables(spark, tables):
    rows = [(1, "u", page(FURNITURE + f"<article>{ARTICLE}</article>" + TAIL)), (1, "u", None), (None, None, "")]
    got = q_extract.op11_html_extraction(spark, tables(pages=rows)).collect()
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in got) == [(0, "", "", 0), (1, "u", "", 0), (1, "u", WANT, len(WANT))]
    assert q_extract.op11_html_extraction(spark, tables()).count() == 0
