"""Main text of pages of several makes."""

from quarry.llm.html_extract import extract


def page(body):
    return f"<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_article_alone():
    body = (
        '<header><h1>Site</h1></header><div id="main-menu"><a>x</a></div><article class="post"><div class="article-header"><h1>Title</h1></div><p>Para one.</p>'
        '<div class="adBox">Buy</div><p>Two<p class=\'cookie-notice\'>We use them<h2>Sub</h2><p>Three</p><section class="comments"><article class="comment"><p>Nice post</p></article></section>'
        "<form><label>Mail</label></form></article><div>Promo text of the site and the world, with many words that is in to for it</div><aside><p>Side</p></aside>"
    )
    assert extract(page(body)) == "Title\nPara one.\nTwo\nSub\nThree"


def test_no_article():
    body = (
        '<div class="content"><h2>Head</h2><p>This is the long text of the page, which has many words and it is for the reader to see that all is well.</p><p>Short.</p></div>'
        '<div class="sidebar"><ul><li><a href=1>L</a></li></ul></div><p hidden>no</p><ul><li><a href="/a">one link that is long enough to be a block of its own here</a></li></ul>'
    )
    assert extract(page(body)).startswith("Head\nThis is the long text")
    assert "no" not in extract(page(body)).split("\n") and "one link" not in extract(page(body))


def test_text_stays_whole():
    assert extract(page("<article><p>a &lt; b &amp;amp; &#233;&nbsp;&copy; x<br>y\n\t z</p><p></p><p>1 < 2</p></article>")) == "a < b &amp; é © x y z\n1 < 2"
    assert extract(page('<article><p title="a > b">one <script>if (a < b) { "</p>" }</script>two<!-- <p>no</p> --></p></article>')) == "one two"
    assert extract("<article><p>cut off in <b>bold") == "cut off in bold"


def test_long_page_is_quick():
    assert len(extract(page("<article>" + "<p>word " * 20_000 + "</article>")).split("\n")) == 20_000
    assert extract("<" * 50_000 + '<a href="' * 1000) is not None
