"""Main text of HTML pages by two passes of block rules.

A page is read into blocks: runs of text between block-level tags, with their length, the share
of it inside links, the share of stop words, and where they stand. The first pass looks at each
block alone. Page furniture - navigation, headers, footers, asides, notices, adverts, comments,
by element, role or name - is bad; so are blocks that are mostly links. Forms and names that pages
also give to their frame (widget, header, promo, ...) are weaker: they count only for a part that holds
no article and, unless an article elsewhere has text, no more than half of the page's text outside
links. What follows "has", "no" or "with" in a name (has-sidebar) names something else, and so does
"header" within an article. If a page has nothing else, it is decided once more without the weak ones. Long blocks
with enough stop words are good. Inside an article or main element any block of some length is good,
and beside one, blocks with hardly any stop words are bad; on a page without, they stay open (code,
tables, names). What is short or in between stays open too. If no article has text and the blocks that are
good by their stop words hold less than half of the text of some length, the page's language is
taken to be none of the list's, and its blocks of some length and few links are good. The second pass
gives open blocks the label of the nearest decided neighbours: that of both if they agree, else
of the nearer one; headings look to what follows. Within an article only neighbours of the same
article count, and where none is decided the article itself does.

Character references are decoded once. White space in a block becomes one space; two line breaks
end a block. A page that ends inside a tag loses that tag. Null and empty pages give an empty text. Repeated
rows get equal texts. Other columns are passed through; those named like a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quaestor.session import ship_package

# Names of elements, roles and classes in HTML pages, and stop words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split())
SILENT = frozenset("head title script style noscript template iframe object svg math canvas audio video select textarea button map applet datalist".split())
IN_HEAD = frozenset("title meta link script style base noscript template".split())
FURNITURE = frozenset("nav header footer aside dialog menu".split())
WEAK_ELEMENTS = frozenset("form fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
MAIN = frozenset("article main".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie "
    "cookies copyright disqus footer gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notices "
    "pagination pager popup popular promo promoted promotion recommended related replies reply respond search share sharing "
    "sidebar signup social sponsor sponsored subscribe subscription tagcloud toolbar widget widgets".split())
WEAK_NAMES = frozenset(
    "banner header legal masthead modal newsletter notice notices popup popular promo promoted promotion search share sharing "
    "signup social subscribe subscription toolbar widget widgets".split())
NOT_ITS_OWN = re.compile(r"(?:^|[_-])(?:has|have|no|not|with|without|hide|hidden|show)[_-]\S*")
OF_ARTICLE = frozenset("article post entry story content main".split())
EVEN_OF_ARTICLE = frozenset("comment comments ad ads related share sidebar footer nav menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
STOP_WORDS = frozenset(
    "the of and to in is that it for was on are as with his they be at this have from or one had by but not what all were we "
    "when your can said there an which their if will each how them then she many some so these would into has more her two him "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach "
    "wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde "
    "le la les de des du et un une en est que qui dans pour pas sur au aux par plus avec ce il ne se sont son ou mais elle nous "
    "vous leur cette ces été être comme tout fait "
    "el los las y que una por con para del se no su lo como más pero sus al esta entre cuando muy sin sobre también hay donde "
    "quien desde todo nos durante uno ni contra otros ese eso ante ellos "
    "il di che e non per una sono della con i gli dei nel alla het van een op te zijn dat met voor niet aan er om ook o a os as "
    "do da em uma não mais".split())

SHORT, LONG = 70, 200
FEW_STOPS, MANY_STOPS = 0.10, 0.25
MOSTLY_LINKS, FEW_LINKS = 0.5, 0.2
#: from here on a character (of Han, kana, Hangul) says as much as two or more letters
WIDE = "\u2e80"
EDGES = ".,;:!?\"'()[]«»„“”‘’…"
BLANK = re.compile(r"[\s_-]+")
CUT_OFF = re.compile(r"<[a-zA-Z/!][^<>]*\Z")

GOOD, BAD, OPEN = 1, -1, 0


class Block:
    """``weak``: numbers of the weakly named elements around it."""
    __slots__ = ("text", "linked", "zone", "furniture", "heading", "weak")

    def __init__(self, text: str, linked: int, zone: int, furniture: bool, heading: bool, weak: tuple = ()):
        self.text, self.linked, self.zone, self.furniture, self.heading, self.weak = text, linked, zone, furniture, heading, weak


class BlockReader(HTMLParser):
    """Blocks of one page. The stack has for each open element its name, and whether it is
    silent, furniture, a heading or a link, the number of its article (0: none), and the numbers of
    the weakly named elements it is in, all as inherited."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.stack: list[tuple] = [("", False, False, False, False, 0, ())]
        self.weak = 0
        self.frames: set[int] = set()  # weakly named elements with an article inside
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.articles = 0
        self.breaks = 0

    def end_block(self) -> None:
        self.breaks = 0
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                _, _, furniture, heading, _, zone, weak = self.stack[-1]
                self.blocks.append(Block(text, len(" ".join("".join(self.linked).split())), zone, furniture, heading, weak))
            self.parts, self.linked = [], []

    def is_furniture(self, tag: str, attrs: list, zone: int) -> tuple[bool, bool]:
        """Whether the element is furniture, and whether it is so by a weak name."""
        if tag in FURNITURE and not (tag == "header" and zone):
            return True, False
        if tag in MAIN or tag in ("html", "body"):
            return False, False
        weak = tag in WEAK_ELEMENTS
        for name, value in attrs:
            if name == "role" and value:
                if value.strip().lower() in ROLES:
                    return value.strip().lower() != "form", True
            elif name in ("class", "id") and value:
                words = {w for token in value.lower().split() for w in BLANK.split(NOT_ITS_OWN.sub("", token))}
                if zone:
                    words.discard("header")
                found = words & NAMES
                if found - WEAK_NAMES and (not words & OF_ARTICLE or found & EVEN_OF_ARTICLE):
                    return True, False
                weak = weak or bool(found) and not words & OF_ARTICLE
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True, False
        return False, weak

    def close_open(self, names: frozenset, stops: frozenset | None) -> None:
        """End the innermost open element of ``names`` unless another kind stands between."""
        for at in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[at][0]
            if tag in names:
                del self.stack[at:]
                return
            if (tag not in INLINE) if stops is None else (tag in stops):
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.breaks += 1
            if self.breaks > 1:
                self.end_block()
            else:
                self.parts.append(" ")
            return
        if self.stack[-1][0] == "head" and tag not in IN_HEAD:
            self.stack.pop()
        if tag not in INLINE and tag not in SILENT:
            self.end_block()
            self.close_open(frozenset(("p", *HEADINGS)), None)
            if tag == "li":
                self.close_open(frozenset(("li",)), frozenset(("ul", "ol")))
            elif tag in ("dt", "dd"):
                self.close_open(frozenset(("dt", "dd")), frozenset(("dl",)))
            elif tag in ("td", "th", "tr"):
                self.close_open(frozenset(("td", "th") if tag != "tr" else ("tr",)), frozenset(("table",)))
        if tag in VOID:
            return
        _, silent, furniture, heading, link, zone, weak = self.stack[-1]
        if tag in MAIN and not zone:
            self.articles += 1
            zone = self.articles
            self.frames.update(weak)
        named, weakly = self.is_furniture(tag, attrs, zone)
        if weakly and not named:
            self.weak += 1
            weak = (*weak, self.weak)
        self.stack.append((tag, silent or tag in SILENT, furniture or named,
                           heading or tag in HEADINGS, link or tag == "a", zone, weak))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in SILENT:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        if tag not in INLINE and tag not in SILENT:
            self.end_block()
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at][0] == tag:
                del self.stack[at:]
                return
            if tag in INLINE and self.stack[at][0] not in INLINE:
                return  # a stray end tag of a phrase ends no block

    def handle_data(self, data: str) -> None:
        _, silent, _, _, link, _, _ = self.stack[-1]
        if silent:
            return
        if not data.isspace():
            self.breaks = 0
        self.parts.append(data)
        if link:
            self.linked.append(data)


def read_blocks(html: str) -> tuple[list[Block], set[int]]:
    """Blocks, and the weakly named elements that frame an article."""
    reader = BlockReader()
    reader.feed(CUT_OFF.sub("", html))
    reader.close()
    reader.end_block()
    return reader.blocks, reader.frames


def weak_furniture(blocks: list[Block], frames: set[int]) -> set[int]:
    """The weakly named elements whose names count: they hold no article, and no more than half of the
    page's text outside links unless an article outside of them has text."""
    plain = [0 if b.furniture else len(b.text) - b.linked for b in blocks]
    articles = sum(n for b, n in zip(blocks, plain) if b.zone)
    held: dict[int, int] = {}
    of_articles: dict[int, int] = {}
    for block, n in zip(blocks, plain):
        for weak in block.weak:
            held[weak] = held.get(weak, 0) + n
            of_articles[weak] = of_articles.get(weak, 0) + (n if block.zone else 0)
    total = sum(plain)
    return {weak for weak, n in held.items() if weak not in frames and (articles > of_articles[weak] and 2 * of_articles[weak] <= articles or 2 * n <= total)}


def stop_share(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(EDGES) in STOP_WORDS for w in words) / len(words)


def extent(text: str) -> int:
    return len(text) if text.isascii() else len(text) + sum(WIDE <= c for c in text)


def first_label(block: Block) -> int:
    if block.furniture:
        return BAD
    size = extent(block.text)
    links = block.linked / len(block.text)
    if links > MOSTLY_LINKS and not (block.zone and size >= LONG):
        return OPEN if block.zone and block.heading else BAD
    if size < SHORT:
        return OPEN
    if block.zone:
        return GOOD
    stops = stop_share(block.text)
    if stops >= MANY_STOPS and size >= LONG:
        return GOOD
    return OPEN if stops >= FEW_STOPS else BAD


def first_labels(blocks: list[Block]) -> list[int]:
    labels = [first_label(b) for b in blocks]
    if any(b.zone and label == GOOD for b, label in zip(blocks, labels)):
        return labels
    # no article tells the text apart: stop words do if most of it is in their languages
    texts = [i for i, b in enumerate(blocks) if not b.furniture and b.linked <= MOSTLY_LINKS * len(b.text) and extent(b.text) >= SHORT]
    sure = sum(extent(blocks[i].text) for i in texts if labels[i] == GOOD)
    unlisted = 2 * sure < sum(extent(blocks[i].text) for i in texts)
    for i in texts:
        if labels[i] != GOOD:
            labels[i] = GOOD if unlisted and blocks[i].linked <= FEW_LINKS * len(blocks[i].text) else OPEN
    return labels


def second_labels(blocks: list[Block], labels: list[int]) -> list[int]:
    """Labels with every open one decided from the nearest decided neighbours."""
    n = len(blocks)
    before: list[tuple[int, int]] = [(n, OPEN)] * n
    after: list[tuple[int, int]] = [(n, OPEN)] * n
    for order, out in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[int, int] = {}
        for i in order:
            zone = blocks[i].zone
            if zone in last:
                out[i] = (abs(i - last[zone]), labels[last[zone]])
            if labels[i] != OPEN and not (zone and blocks[i].furniture):
                last[zone] = i
    decided = list(labels)
    for i, block in enumerate(blocks):
        if labels[i] != OPEN:
            continue
        (far_before, left), (far_after, right) = before[i], after[i]
        if left == OPEN and right == OPEN:
            decided[i] = GOOD if block.zone or extent(block.text) >= SHORT else BAD
        elif block.zone and GOOD in (left, right):
            decided[i] = GOOD
        elif left == right or right == OPEN:
            decided[i] = left
        elif left == OPEN or block.heading:
            decided[i] = right
        elif far_before == far_after:
            decided[i] = GOOD if extent(block.text) >= SHORT else BAD
        else:
            decided[i] = left if far_before < far_after else right
    return decided


def labelled(blocks: list[Block]) -> list[str]:
    labels = second_labels(blocks, first_labels(blocks))
    return [b.text for b, label in zip(blocks, labels) if label == GOOD]


def main_text(html: str | None) -> str:
    blocks, frames = read_blocks(html) if html else ([], set())
    by_name = weak_furniture(blocks, frames)
    named = [b for b in blocks if not b.furniture and not by_name.isdisjoint(b.weak)]
    for block in named:
        block.furniture = True
    found = labelled(blocks)
    if not found and named:
        for block in named:
            block.furniture = False
        found = labelled(blocks)
    return "\n".join(found)


def extractor(html: str, schema: list[str]) -> Callable:
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [main_text(h) for h in part.column(html).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in schema] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    [*schema, "text", "n_chars"])
    return extract


def extract_text(pages: DataFrame, html: str = "html", keep_html: bool = False) -> DataFrame:
    """``pages`` with text and n_chars (code points); the page itself only with ``keep_html``."""
    ship_package(pages.sparkSession)
    keep = [f for f in pages.schema.fields if f.name not in ("text", "n_chars") and (keep_html or f.name != html)]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(*dict.fromkeys([*names, html])).mapInArrow(extractor(html, names), schema)
