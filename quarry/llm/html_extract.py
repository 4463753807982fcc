"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. Elements that never hold the article (menus, page headers,
footers, sidebars, forms, scripts, hidden ones) are left out, and so are elements whose class, id or role names
them as such: at once where the whole name is one of FIRM or names readers' comments, otherwise only where the
element doesn't hold most of the page's text. On a paragraph or heading such a name is a doubt about the block
only, and an id on a heading, which is an anchor, none.

Pass one classifies blocks by length, link density and the density of stop words: a long block with stop words is
good; one that is mostly links, or doubtful and not good, is bad; a long one without stop words is bad outside the
article. The others are ambiguous: short blocks, headings, and in the article any block that isn't long and dense, and
a paragraph that is one link. Pass two gives ambiguous blocks the label of their nearest decided neighbours on the
same side of the article's edge: good if either is; in the article good but for a heading between bad blocks; without
decided neighbours good in the article. Where an element holds the article, good blocks outside it are no part of
it, unless they hold BESIDE times its text. Where no block of a page has the share of stop words, as in other
languages, length and link density decide. The head ends where anything but metadata begins, a left-out element
with its parent, and a menu where an article begins.

Defined results: null or empty html gives an empty text; unclosed elements end where their parent or the
page does; a bad character reference stays as it is; long pages are read whole; each row is extracted by itself, so
repeated rows and ids come back each; an empty table gives none; columns of pages keep their names and values, but
for the html and for ones named as those that are added, which these replace.
"""

from __future__ import annotations

import html as entities
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import releasing, small_batches

# Elements and words that mark parts of a page beside its article.
OUT = frozenset("nav footer aside form dialog menu head".split())
OUT_WORD = re.compile(
    r"(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|"
    r"sidebar|side|aside|widget|menu\w*|nav\w*|navbar|breadcrumbs?|pagination|pager|toolbar|tabs|footer|header|masthead|topbar|comments?|commentlist|disqus|replies|respond|"
    r"share|sharing|social|related|recommend\w*|tags|search|form|legal|disclaimer|teaser)",
    re.I,
)
FIRM = re.compile(r"(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|cookies?|consent|gdpr|newsletter|sidebar|nav|navbar|navigation|breadcrumbs?|pagination|footer|masthead|topbar)", re.I)
READERS = frozenset("comment comments commentlist disqus reply replies respond".split())
STATES = frozenset("open closed on off enabled disabled count link number".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd dt figcaption span b i em strong a".split())
PART = re.compile(r"[\s_:-]+|(?<=[a-z])(?=[A-Z])")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
OUT_ROLE = re.compile(r"\brole\s*=\s*[\"']?(?:navigation|banner|contentinfo|complementary|search|form|dialog|alert|menu)", re.I)
NAMED = re.compile(r"\b(class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
STOP = frozenset(
    "the of and to in a is that for it as was with be by on not he this are or his from at which but have an they you were her all she there been one their we him has when who will "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man sein "
    "le la les de des et en un une du est que dans pour qui sur pas ce au plus par avec il ne se sont aux son sa ont mais comme ou si leur elle cette été nous vous ces "
    "el los las y que del por con una para su no lo al más se sus como ha pero este o fue ya entre cuando muy sin sobre también me hasta hay donde desde".split()
)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|textarea|iframe|object|select|button|title|canvas|audio|video)\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*+(?:>|\Z)|<[!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)

METADATA = frozenset("base link meta".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NESTED = BLOCK - frozenset("dd dt li optgroup option p tbody td tfoot th thead tr".split())  # their end tags aren't optional
MODIFIER = frozenset("with without no not has have hide hidden show toggle is non".split())

LONG, SHORT = 70, 25
LINKED, STOPPED = 0.5, 0.12
BESIDE = 4


def _of_readers(parts: list[str]) -> bool:
    """Whether a name is that of readers' comments, and not of a state that an article has."""
    return any(w in READERS and not (i and parts[i - 1] in MODIFIER) and not (i + 1 < len(parts) and parts[i + 1] in STATES) for i, w in enumerate(parts))


def _beside(attributes: str, tag: str, inside: bool) -> str:
    """Whether an element's attributes say that it isn't of the article: sure, maybe, doubt (of the block alone) or nothing."""
    if HIDDEN.search(attributes):
        return "sure"
    if tag in ("main", "body", "html"):
        return ""
    if OUT_ROLE.search(attributes):
        return "maybe" if tag in PARAGRAPHS else "sure"
    heading = tag in HEADINGS
    found = ""
    for m in NAMED.finditer(attributes):
        if heading and m[1].lower() == "id":
            continue
        for name in (m[2] or m[3] or m[4] or "").split():
            parts = [w.lower() for w in PART.split(name) if w]
            if _of_readers(parts):
                return "sure"
            if tag == "article":
                found = "maybe" if "teaser" in parts else found
                continue
            for i, w in enumerate(parts):
                if not OUT_WORD.fullmatch(w) or inside and w in ("header", "masthead") or i and parts[i - 1] in MODIFIER or w in READERS:
                    continue
                if tag in PARAGRAPHS:
                    found = found or "doubt"
                elif len(parts) == 1 and FIRM.fullmatch(w):
                    return "sure"
                else:
                    found = "maybe"
    return found


def _most(page: str) -> set[int]:
    """Where elements begin that hold more than half of the page's text."""
    total, at = 0, 0
    stack: list[tuple[str, int, int]] = []
    last: dict[str, int] = {}  # how many of each name are open
    held: list[tuple[int, int]] = []
    for m in TOKEN.finditer(page):
        total += len(page[at : m.start()].strip())
        at, tag = m.end(), (m[3] or "").lower()
        if tag not in NESTED or tag in VOID:
            continue
        if not m[2]:
            stack.append((tag, m.start(), total))
            last[tag] = last.get(tag, 0) + 1
        elif last.get(tag):
            while True:
                name, begin, before = stack.pop()
                last[name] -= 1
                held.append((begin, total - before))
                if name == tag:
                    break
    total += len(page[at:].strip())
    held += [(begin, total - before) for _, begin, before in stack]
    return {begin for begin, n in held if 2 * n > total}


class Block(NamedTuple):
    text: str
    linked: int  # characters in links
    article: bool
    heading: bool
    paragraph: bool
    doubt: bool


def blocks(page: str) -> list[Block]:
    found, parts, linked = [], [], 0
    skip: list[str] = []  # open elements from the one that is left out
    nested: dict[str, int] = {}  # how many of each name are open around it
    most: set[int] | None = None
    article, heading, paragraph, doubt, anchors, at = 0, False, False, False, 0, 0

    def close() -> None:
        nonlocal linked, doubt
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                found.append(Block(text, linked, article > 0, heading, paragraph, doubt))
            parts.clear()
        linked, doubt = 0, False

    for m in TOKEN.finditer(page):
        piece = page[at : m.start()]
        if skip == ["head"] and piece.strip():
            skip.clear()
        if piece and not skip:
            parts.append(piece)
            linked += len(piece.strip()) * (anchors > 0)
        at, tag = m.end(), m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if skip and skip[0] == "head" and not m[2] and tag not in METADATA and tag != "head":
            skip.clear()
        if m[2]:
            if skip:
                if tag in skip:
                    while skip.pop() != tag:
                        pass
                    continue
                if tag not in ("article", "main", "body", "html") and not nested.get(tag):
                    continue
                skip.clear()
            if nested.get(tag):
                nested[tag] -= 1
            if tag == "a":
                anchors = max(0, anchors - 1)
            elif tag in BLOCK:
                close()
                heading, paragraph, anchors = False, False, 0
                if tag in ("article", "main"):
                    article = max(0, article - 1)
            continue
        if tag in VOID:
            if not skip and tag == "br":
                parts.append(" ")
            elif not skip and tag in BLOCK:
                close()
            continue
        if skip:
            if skip[0] == "p" and tag in BLOCK or skip[0] in ("nav", "menu") and (tag == "main" or tag == "article" and not _beside(m[4], tag, False)):
                skip.clear()
            else:
                if not m[4].endswith("/"):
                    skip.append(tag)
                continue
        if tag in BLOCK:
            close()
            heading, paragraph, anchors = tag in HEADINGS, tag == "p", 0
        out = "maybe" if tag == "form" else "sure" if tag in OUT or tag == "header" and not article else _beside(m[4], tag, article > 0) if m[4] else ""
        if out == "doubt":
            doubt, out = True, ""
        if out == "maybe":
            most = _most(page) if most is None else most
            out = "" if m.start() in most else out
        if out:
            skip.append(tag)
            continue
        if tag in NESTED:
            nested[tag] = nested.get(tag, 0) + 1
        if tag in ("article", "main"):
            article += 1
        elif tag == "a":
            anchors += 1
    if at < len(page) and not skip:
        parts.append(page[at:])
    close()
    return found


def _stops(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?") in STOP for w in words) / len(words)


def first_pass(found: list[Block]) -> list[bool | None]:
    """Good, bad or ambiguous, by a block's own length, links and stop words."""
    first: list[bool | None] = []
    plain: list[int] = []  # long blocks without many links that only lack stop words
    for b in found:
        if b.linked > LINKED * len(b.text):
            first.append(None if b.article and b.paragraph and not b.doubt else False)
        elif b.heading or len(b.text) < SHORT:
            first.append(False if b.doubt else None)
        elif len(b.text) >= LONG and _stops(b.text) >= STOPPED:
            first.append(True)
        else:
            if len(b.text) >= LONG:
                plain.append(len(first))
            first.append(False if b.doubt or len(b.text) >= LONG and not b.article else None)
    if True not in first:
        for i in plain:
            first[i] = True
    return first


def _nearest(first: list[bool | None], found: list[Block]) -> list[bool | None]:
    """For each block the last decided label before it on its side of the article's edge."""
    out, last, side = [], None, None
    for x, b in zip(first, found, strict=True):
        if b.article != side:
            last, side = None, b.article
        out.append(last)
        last = x if x is not None else last
    return out


def labels(found: list[Block]) -> list[bool]:
    first = first_pass(found)
    before, after = _nearest(first, found), _nearest(first[::-1], found[::-1])[::-1]
    out = []
    for x, b, left, right in zip(first, found, before, after, strict=True):
        if x is not None:
            out.append(x)
        elif left is None and right is None:
            out.append(b.article)
        else:
            # in the article, a list of links beside it says nothing of a short block
            between = b.heading and left is False and right is False
            out.append(bool(left or right) or b.article and not between)
    held = [sum(len(b.text) for good, b in zip(out, found, strict=True) if good and b.article == side) for side in (False, True)]
    if held[1] and held[0] <= BESIDE * held[1]:
        # where an element holds the article, what is beside it isn't part of it
        out = [good and b.article for good, b in zip(out, found, strict=True)]
    return out


def extract(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, good in zip(found, labels(found), strict=True) if good)


def extract_pages(pages: DataFrame, html: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """pages without html, with text and n_chars, its code points."""
    kept = [f for f in pages.schema.fields if f.name not in (html, text, n_chars)]

    def run(batches):
        for batch in batches:
            found = [extract(x) for x in batch.column(html).to_pylist()]
            columns = [batch.column(f.name) for f in kept] + [pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), text, n_chars])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{text}` string", f"`{n_chars}` long"])
    small_batches(pages.sparkSession)
    return pages.select(*[f.name for f in kept], html).mapInArrow(releasing(run), schema)


def op10_html_extract(pages: DataFrame) -> DataFrame:
    return extract_pages(pages.select("page_id", "url", "html"))
