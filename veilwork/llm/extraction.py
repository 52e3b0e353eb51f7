"""Main text of HTML pages by two-pass block rules.

Tags cut a page into blocks. The first pass decides blocks by what holds them (menus, forms, page frames, elements whose
class or id names an advert, notice, sidebar or comment), by link density, by stop-word density and by length. Short and
middling blocks stay open; in the second pass they take the label of the nearest decided neighbours: good if both sides
are, or if the nearer one is (bad if a good and a bad one are equally near; the page's edges are bad). Inside an <article> or <main> the element's own edges count as good neighbours.

A frame that only wraps the page (a form, a box for notices or sharing) does not count for an article that it holds. On a
page whose long blocks have hardly any of the known stop words, the language is none of those, and length and links
decide alone. A page that would have no text at all is judged again without the names of classes and without forms.

Tags are found in one pass over the page: each search goes on from where the last one ended, or is not made again once it
has found nothing.

Defined results: null html counts as empty and has empty text; unclosed and stray tags, comments and attributes are
tolerated; a `<` that no `>` follows is text; bytes that are no UTF-8 count as U+FFFD; a page without a good block has
empty text; repeated rows are extracted one by one; a null id or url stays null; other columns are not read; pages of any
length are read whole, and no kept block is cut.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from veilwork.llm.common import map_arrow, table, valid_utf8

_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
_QUOTE = re.compile(r"=\s*([\"'])")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[^\W\d_]+")

#: Elements whose content is not text, or is no part of any article.
SKIPPED = frozenset("script style noscript template iframe object svg canvas select textarea button head title form nav footer aside dialog".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
#: Elements that end a block.
BREAKING = frozenset("address article aside blockquote body button canvas center dd details dialog div dl dt fieldset figcaption figure footer form frame h1 h2 h3 h4 h5 h6 head header hr html iframe li main menu nav noscript object ol option p pre section select summary svg table tbody td template textarea tfoot th thead title tr ul".split())
#: Elements that end with their own end tag or with that of what holds them.
HOLDING = frozenset("address article aside blockquote body button center details dialog div dl fieldset figure footer form head header main menu nav object ol section select svg table td ul canvas".split())
#: Words in a class, id or role that mark page parts other than the article.
FRAME_WORDS = frozenset("ad ads advert advertisement advertising sponsor sponsored promo banner cookie cookies consent notice alert popup modal newsletter subscribe sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead toolbar share sharing social related recommended comment comments disqus reply replies respond form login search widget copyright legal contentinfo complementary".split())
#: Frames of page parts that may hold articles of their own, which are not the page's: teasers, comments.
STRONG_WORDS = frozenset("sidebar aside nav navbar navigation menu footer related recommended comment comments disqus reply replies respond ad ads advert advertisement advertising sponsor sponsored promo".split())
STRONG = frozenset("nav footer aside".split())
#: Words beside a frame word that make a class name tell of the page, not of the element.
STATE_WORDS = frozenset("has with no without is not open closed enabled disabled on off".split())
ARTICLE_WORDS = frozenset("article post story entry main".split())
#: Common words of the languages that pages are expected in.
STOP_WORDS = frozenset(
    "the of and to in a is that it for on with as was by this are from be at or an which not have has but they we you their its"
    " der die das und ist in von zu mit den auf für im nicht ein eine dem des sich auch es an werden aus er hat dass sie nach"
    " le la les de des et en un une du est que qui dans pour sur par au il ne pas plus avec ce se sont aux ou son"
    " el los las y del que es por con para una su al lo como más pero sus o este sí porque esta entre".split()
)
LONG, SHORT, MANY_LINKS, MANY_STOPS, SOME_STOPS, FEW_STOPS = 200, 70, 0.33, 0.30, 0.18, 0.05


class Block(NamedTuple):
    text: str
    links: float  # share of the text that is in links
    framed: bool
    article: int  # number of the article that holds it; 0: none
    bare: bool  # framed even if names of classes and forms don't count


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start, end, name, whether it closes, and attributes of each tag, comment and declaration (name empty)."""
    at, last, no_more = 0, page.rfind(">"), {}

    def find(what: str, low: int) -> int:
        if no_more.get(what, len(page)) <= low:
            return -1
        found = page.find(what, low)
        if found < 0:
            no_more[what] = low
        return found

    while 0 <= (start := page.find("<", at)) < last:
        at = start + 1
        if page.startswith("<!--", start):
            end = find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            yield start, at, "", False, ""
        elif page[at] in "!?":
            at = page.find(">", at) + 1
            yield start, at, "", False, ""
        elif name := _NAME.match(page, at):
            low = name.end()
            while True:  # the end is the first > outside quoted values
                end = page.find(">", low)
                quote = _QUOTE.search(page, low, end) if end >= 0 else None
                if quote is None:
                    break
                closes = find(quote[1], quote.end())
                if closes < 0:
                    break
                low = closes + 1
            if end < 0:
                end = page.find(">", name.end())
            at = end + 1
            closing = name[0][0] == "/"
            yield start, at, name[0].lstrip("/").lower(), closing, page[name.end() : end]


def _kinds(name: str, attributes: str, in_article: bool) -> tuple[bool, bool, bool, bool]:
    """Whether an element is an article, a frame, one that counts for articles in it too, and a frame by its name alone (forms apart)."""
    names = [frozenset(re.split(r"[^a-z]+", one)) for m in _NAMED.finditer(attributes) for one in (m[1] or m[2] or m[3] or "").lower().split()]
    told = [w for w in names if w & FRAME_WORDS and not w & STATE_WORDS]
    article = name in ("article", "main") or name in ("div", "section") and any(w & ARTICLE_WORDS and not w & FRAME_WORDS for w in names)
    by_name = name in SKIPPED or name == "header" and not in_article
    by_class = bool(told) and not article and name != "body"
    return article, by_name or by_class, name in STRONG or by_class and any(w & STRONG_WORDS for w in told), by_name and name != "form"


def _split(page: str) -> Iterator[Block]:
    held: list[tuple[str, bool, bool, bool, bool]] = []
    names: Counter[str] = Counter()
    parts: list[str] = []
    in_link = frames = strong = bare = articles = number = linked = 0
    outside = (0, 0)  # weak frames that hold the article
    at = resume = 0

    def block() -> Iterator[Block]:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        density = min(1.0, linked / max(1, len(text)))
        parts.clear()
        linked = 0
        weak, weak_bare = outside if articles else (0, 0)
        if text:
            yield Block(text, density, frames > weak, number if articles else 0, bare > weak_bare)

    def add(stop: int) -> None:
        nonlocal linked
        if stop > at:
            parts.append(page[at:stop])
            if in_link:
                linked += len(page[at:stop].strip())

    for start, end, name, closing, attributes in _tags(page):
        if start < resume:  # in the content of a script or the like
            continue
        add(start)
        at = end
        if name == "a":
            in_link = 0 if closing else 1
        elif name == "br":
            parts.append(" ")
        if name not in BREAKING and name not in RAW:
            continue
        yield from block()
        if name in RAW:
            if not closing:
                close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = resume = close.end() if close else len(page)
            continue
        in_link = in_link if name in ("p", "li") and closing else 0
        if name not in HOLDING:
            continue
        if not closing:
            if attributes.endswith("/"):
                continue
            article, frame, is_strong, by_name = _kinds(name, attributes, articles > 0)
            if article and not articles:
                number += 1
                outside = (frames - strong, bare - sum(h[3] and h[4] for h in held))
            held.append((name, frame, article, is_strong, by_name))
            names[name] += 1
            frames += frame
            strong += frame and is_strong
            bare += by_name
            articles += article
        elif names[name]:
            while True:
                last, frame, article, is_strong, by_name = held.pop()
                names[last] -= 1
                frames -= frame
                strong -= frame and is_strong
                bare -= by_name
                articles -= article
                if last == name:
                    break
    add(len(page))
    yield from block()


def _stops(text: str) -> float:
    words = [w.lower() for w in _WORDS.findall(text)]
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def _first_pass(b: Block, framed: bool, stops: float, known: bool) -> int:
    """1 good, -1 bad, 0 open."""
    if framed or b.links > MANY_LINKS:
        return -1
    if len(b.text) < SHORT:
        return -1 if b.links > 0 and not b.article else 0
    if not known:
        return 1 if len(b.text) > LONG or b.article else 0
    if stops >= MANY_STOPS and len(b.text) > LONG or stops >= SOME_STOPS and b.article:
        return 1
    if stops >= SOME_STOPS:
        return 1 if len(b.text) > LONG else 0
    return 0 if b.article or len(b.text) > LONG else -1


def main_text(page: str | None) -> str:
    """The page's article as one line of text."""
    blocks = list(_split(page or ""))
    stops = [_stops(b.text) if len(b.text) >= SHORT else 0.0 for b in blocks]
    long_ = [(len(b.text), s) for b, s in zip(blocks, stops, strict=True) if len(b.text) >= SHORT and b.links <= MANY_LINKS and not b.bare]
    known = sum(n * s for n, s in long_) >= FEW_STOPS * sum(n for n, _ in long_)
    return _kept(blocks, [_first_pass(b, b.framed, s, known) for b, s in zip(blocks, stops, strict=True)]) or _kept(blocks, [_first_pass(b, b.bare, s, known) for b, s in zip(blocks, stops, strict=True)])


def _kept(blocks: list[Block], first: list[int]) -> str:
    """The second pass: what is open takes the label of its neighbours."""
    n = len(blocks)
    kept = []
    before: list[tuple[int, int]] = []  # label and distance of the nearest decided block, or edge of the article
    label, distance = -1, 0
    for k, (b, f) in enumerate(zip(blocks, first, strict=True)):
        if b.article and (not k or blocks[k - 1].article != b.article):
            label, distance = 1, 0
        elif k and not b.article and blocks[k - 1].article:
            label, distance = -1, 0
        distance += 1
        before.append((label, distance))
        if f and not (b.article and f < 0):  # a bad block inside an article says nothing about its neighbours
            label, distance = f, 0
    label, distance = -1, 0
    for k in range(n - 1, -1, -1):
        b, f = blocks[k], first[k]
        if b.article and (k == n - 1 or blocks[k + 1].article != b.article):
            label, distance = 1, 0
        elif k < n - 1 and not b.article and blocks[k + 1].article:
            label, distance = -1, 0
        distance += 1
        near = before[k]
        good = f > 0 or f == 0 and (near[0] > 0 and label > 0 or near[0] > 0 and near[1] < distance or label > 0 and distance < near[1])
        if good:
            kept.append(b.text)
        if f and not (b.article and f < 0):
            label, distance = f, 0
    return " ".join(reversed(kept))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in valid_utf8(batch.column(2)).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return map_arrow(pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html"), _rows, "page_id long, url string, text string, n_chars long")


def op8_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
