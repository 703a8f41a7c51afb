"""Marked pieces of HTML pages. A layout names the element that is a block and those inside it
that matter; the reader lists them flat, in page order, with their raw text pieces. It decides
nothing: letters, trims, completeness and order are column expressions of the caller."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa

# HTML elements without an end, and those whose content is no text.
NO_END = frozenset("area base br col embed hr img input link meta source track wbr".split())
NO_TEXT = frozenset(("script", "style", "template"))

NODE = "struct<role:string,value:string,within:array<int>,pieces:array<string>>"
PAGE_BLOCKS = f"array<struct<value:string,nodes:array<{NODE}>>>"
_ARROW_NODE = pa.struct([("role", pa.string()), ("value", pa.string()), ("within", pa.list_(pa.int32())), ("pieces", pa.list_(pa.string()))])
_ARROW_BLOCKS = pa.list_(pa.struct([("value", pa.string()), ("nodes", pa.list_(_ARROW_NODE))]))


@dataclass(frozen=True)
class Mark:
    """An element that matters. All given conditions hold; ``classes``: any one of them;
    ``class_parts``: any one occurs anywhere in the class attribute, as an alternative."""

    role: str
    tag: str | None = None
    classes: tuple[str, ...] = ()
    class_parts: tuple[str, ...] = ()
    id_end: str = ""
    has: tuple[str, str] | None = None  # attribute that is there and contains a text
    take: str = ""  # attribute whose value comes along

    def fits(self, tag: str, attrs: dict[str, str]) -> bool:
        if self.tag and tag != self.tag:
            return False
        names = attrs.get("class", "")
        if (self.classes or self.class_parts) and not (
                set(self.classes) & set(names.split()) or any(p in names for p in self.class_parts)):
            return False
        if self.has and (self.has[0] not in attrs or self.has[1] not in attrs[self.has[0]]):
            return False
        return attrs.get("id", "").endswith(self.id_end)


@dataclass(frozen=True)
class BlockLayout:
    block: Mark
    marks: tuple[Mark, ...]


# Elements, classes and attributes of the two sites' question pages.
SITE_A = BlockLayout(
    Mark("block", "div", ("sim-questao",), take="data-sid"),
    (
        Mark("statement", "p", ("sim-enunciado",)),
        Mark("option", "button", ("btn-sim-alt",), take="data-letra"),
        Mark("origin", "a", ("sim-prova-link",)),
        Mark("base_text", "div", ("sim-texto", "sim-texto-base"), ("texto-associado", "texto-base")),
        Mark("image", "img", take="src"),
        Mark("background", has=("style", "background-image"), take="style"),
    ),
)
SITE_B = BlockLayout(
    Mark("block", "div", ("q-question-item",)),
    (
        Mark("code", classes=("q-id",)),
        Mark("statement", classes=("q-question-enunciation",)),
        Mark("option", "label", ("q-radio-button",)),
        Mark("letter", classes=("q-option-item",)),
        Mark("trail", classes=("q-question-breadcrumb",)),
        Mark("link", "a"),
        Mark("info", classes=("q-question-info",)),
        Mark("base_text", "div", ("collapse",), id_end="-text"),
        Mark("image", "img", take="src"),
        # state of the block for answering
        Mark("answer_button", "button", ("js-answer-btn",), take="data-question-id"),
        Mark("answer_off", "button", ("js-answer-btn",), has=("aria-disabled", "true")),
        Mark("answer_off", "button", ("js-answer-btn",), has=("disabled", "")),
        Mark("answer_off", "button", ("js-answer-btn",), has=("data-limit-reached", "true")),
    ),
)
LAYOUTS = {"a": SITE_A, "b": SITE_B}


@dataclass
class _Block:
    value: str
    nodes: list[dict] = field(default_factory=list)
    open: list[int] = field(default_factory=list)


class MarkReader(HTMLParser):
    """One pass over a page: a stack of open elements, each with the blocks and nodes it began."""

    def __init__(self, layout: BlockLayout):
        super().__init__(convert_charrefs=True)
        self.layout = layout
        self.blocks: list[_Block] = []
        self.current: list[_Block] = []
        self.stack: list[tuple[str, list[_Block], list[_Block]]] = []
        self.mute = 0

    def begin(self, tag: str, attributes: list) -> tuple[list[_Block], list[_Block]]:
        attrs = {name: value or "" for name, value in attributes}
        marked = [m for m in self.layout.marks if m.fits(tag, attrs)] if self.current else []
        touched = []
        for block in self.current:
            around = list(block.open)
            for mark in marked:
                block.nodes.append({"role": mark.role, "value": attrs.get(mark.take), "within": around, "pieces": []})
                block.open.append(len(block.nodes) - 1)
                touched.append(block)
        opened = []
        if self.layout.block.fits(tag, attrs):
            opened = [_Block(attrs.get(self.layout.block.take, ""))]
            self.blocks += opened
            self.current += opened
        return opened, touched

    def end(self, opened: list[_Block], touched: list[_Block]) -> None:
        for block in touched:
            block.open.pop()
        for block in opened:
            self.current.remove(block)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        began = self.begin(tag, attrs)
        if tag in NO_END:
            self.end(*began)
        else:
            self.stack.append((tag, *began))
            self.mute += tag in NO_TEXT

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.end(*self.begin(tag, attrs))

    def handle_endtag(self, tag: str) -> None:
        if any(open_tag == tag for open_tag, _, _ in self.stack):
            closed = ""
            while closed != tag:
                closed, opened, touched = self.stack.pop()
                self.mute -= closed in NO_TEXT
                self.end(opened, touched)

    def handle_data(self, data: str) -> None:
        if not self.mute:
            for block in self.current:
                for node in block.open:
                    block.nodes[node]["pieces"].append(data)


def read_marks(html: str, layout: BlockLayout) -> list[dict]:
    reader = MarkReader(layout)
    reader.feed(html)
    reader.close()
    return [{"value": b.value, "nodes": b.nodes} for b in reader.blocks]


def mark_pages(layout: str, carry: list[str], part: int = 128):
    """Arrow batches of pages to batches of ``carry``, blocks, fault; a page that cannot be read
    has the reason as ``fault`` and no blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, part):
                piece = batch.slice(start, part)
                blocks, faults = [], []
                for html in piece.column("html").to_pylist():
                    try:
                        blocks.append(read_marks(html, LAYOUTS[layout]) if html else [])
                        faults.append(None)
                    except Exception as error:  # one page must not end the job
                        blocks.append([])
                        faults.append(f"{type(error).__name__}: {error}")
                yield pa.RecordBatch.from_arrays(
                    [piece.column(c) for c in carry] + [pa.array(blocks, _ARROW_BLOCKS), pa.array(faults, pa.string())], [*carry, "blocks", "fault"])
    return run
