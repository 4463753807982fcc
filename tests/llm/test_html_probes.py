"""Names of classes and ids that say nothing against a text, and pages beside the rule."""

import pytest

from quarry.llm.html_extract import Block, extract, first_pass, labels

TEXT = "It was late in the year when the two of them came to the house by the sea, and there was not a light in it."
MORE = "The door had been left open, as if someone was to be back at any time, but the rooms were cold and there was dust on all of the chairs."

ITALIAN = "Quando tornarono a casa, dopo molti anni, trovarono soltanto silenzio, polvere, finestre rotte, ricordi lontani, mobili vecchi."


def page(body):
    return f"<!DOCTYPE html><html><head><title>no</title></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "body,want",
    [
        (f'<div class="content with-sidebar"><p>{TEXT}</p></div>', TEXT),
        (f'<article class="post comments-open"><p>{TEXT}</p></article>', TEXT),
        (f'<article><p id="alert">{TEXT}</p></article>', TEXT),
        (f'<article><p class="form">{TEXT}</p></article>', TEXT),
        (f'<article><p>{TEXT}</p><h2 id="related-work">Related work</h2><p>{MORE}</p></article>', f"{TEXT}\nRelated work\n{MORE}"),
        (f'<article><p>{TEXT}</p><p><a href="x">The report of the year before</a></p><p>{MORE}</p></article>', f"{TEXT}\nThe report of the year before\n{MORE}"),
        (f"<article><p>{TEXT} <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p></article>", f"{TEXT} x=2"),
        (f'<div><p>{TEXT}</p><p>{MORE}</p></div><article class="teaser"><p>Read the one on ships.</p></article>', f"{TEXT}\n{MORE}"),
        (f"<div><p>{ITALIAN}</p></div>", ITALIAN),
        (f'<form id="aspnetForm"><div><p>{TEXT}</p></div></form>', TEXT),
        (f'<article><p>{TEXT}</p><div class="comment-list"><p>{MORE}</p></div></article>', TEXT),
        (f'<article><p>{TEXT}</p><div class="related"><h3>Related</h3><ul><li><a href=1>One</a></li></ul></div></article>', TEXT),
        (f"<div class='ad'>{MORE}</div><article><h1>Head</h1><p>Short.</p></article>", "Head\nShort."),
    ],
)
def test_names(body, want):
    assert extract(page(body)) == want


def test_two_passes():
    made = lambda text, linked=0, article=False, heading=False, paragraph=True, doubt=False: Block(text, linked, article, heading, paragraph, doubt)
    found = [made("Menu", 4), made("Title", heading=True), made(TEXT), made("A caption."), made("x" * 90), made("More", 4), made("Elsewhere", heading=True), made("List", 4)]
    assert first_pass(found) == [False, None, True, None, False, False, None, False]
    assert labels(found) == [False, True, True, True, False, False, False, False]


def test_sample_pages_whole(spark):
    """The pages of the test data: their article's blocks, by a plain reading of their fixed make."""
    import html
    import re

    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)
        if not inner:
            continue
        body = re.sub(r"<(script|style)\b.*?</\1>|<!--.*?-->", "", inner[1], flags=re.S)
        parts = re.split(r"</?(?:p|h1|h2|h3|ul|ol|li|div|table|tr|td|blockquote)\b[^>]*>", body.replace("<br>", " "))
        parts = [" ".join(html.unescape(re.sub(r"</?(?:b|i|a|em|strong|span|code)\b[^>]*>", "", x)).split()) for x in parts]
        assert extract(r["html"]) == "\n".join(x for x in parts if x), r["page_id"]
