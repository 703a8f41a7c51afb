"""Question records on pages of a layout that nobody described.

A list of records repeats: below one element of the page, children of one kind follow each other,
alone or each with others after it (heading, text, list, heading, text, list, ...). A page is aligned
with itself: of all parents and kinds that could begin their records, those are taken whose records are
mostly alike inside and hold most text. Records have more than one text each: children of a single one are a
menu, paragraphs or the options of a lone question. A record's texts are then fields by their place, the tag path below the
list. A path that most records have several times is that of the options; of the others the one with
the longest texts is the statement.

Workers list the elements of pages in Arrow batches (number, parent, last element inside, path, shape,
text); everything that is decided is aggregates and windows over those rows, none of them wider than
a page. Pages without such a list have no rows, nor have records without a statement."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaestor.operators.html_blocks import NO_END, NO_TEXT
from quaestor.session import durable, ship_package

#: records that a list has at least, and the share of them that must be alike, or have a field
LEAST_RECORDS = 3
MOST = 0.6
# Elements that end where one of these begins, as HTML lets their end tags be left out.
ENDS_AT = {"li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "option": ("option",)}
# How an option's own letter is written, and letters of options that carry none, by place.
LETTERED = r"^\(?([A-E])\s*[).:–-]\s*"
OPTION_LETTERS = "ABCDE"
ELEMENTS = "pos int, parent int, last int, path array<string>, shape long, chars int, texts int, own string"


class ElementReader(HTMLParser):
    """Elements in page order: parent, kind (tag and classes), own text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.kind, self.own, self.open = [-1], [""], [""], [0]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while self.kind[self.open[-1]].split(".")[0] in ENDS_AT.get(tag, ()):
            self.open.pop()
        self.parent.append(self.open[-1])
        self.kind.append(".".join([tag, *sorted((dict(attrs).get("class") or "").split())]))
        self.own.append("")
        if tag not in NO_END:
            self.open.append(len(self.kind) - 1)

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            if self.kind[self.open[at]].split(".")[0] == tag:
                del self.open[at:]
                return

    def handle_data(self, data: str) -> None:
        at = self.open[-1]
        if self.kind[at].split(".")[0] not in NO_TEXT:
            self.own[at] = " ".join([*self.own[at].split(), *data.split()])

    def rows(self) -> Iterator[tuple]:
        n = len(self.kind)
        last, chars, inside = list(range(n)), [len(t) for t in self.own], [[] for _ in range(n)]
        texts = [int(t != "") for t in self.own]
        shape, paths = [0] * n, [[]] * n
        for at in range(n - 1, -1, -1):
            # what is inside, repeats in a row once: a list of four is like one of five
            kinds = [s for k, s in enumerate(reversed(inside[at])) if k == 0 or s != inside[at][-k]]
            shape[at] = zlib.crc32(f"{self.kind[at]}{kinds}".encode())
            up = self.parent[at]
            if up >= 0:
                last[up], chars[up], texts[up] = max(last[up], last[at]), chars[up] + chars[at], texts[up] + texts[at]
                inside[up].append(shape[at])
        for at in range(1, n):
            paths[at] = [*paths[self.parent[at]], self.kind[at]]
            yield at, self.parent[at], last[at], paths[at], shape[at], chars[at], texts[at], self.own[at]


def lister(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["pos", "parent", "last", "path", "shape", "chars", "texts", "own"]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.int64(), pa.int32(), pa.int32(), pa.string()]
    for batch in batches:
        page = batch.schema.field("page_id").type
        for number, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist()):
            reader = ElementReader()
            reader.feed(html or "")
            reader.close()
            columns = list(zip(*reader.rows())) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number] * len(columns[0]), page), *[pa.array(c, t) for c, t in zip(columns, types)]], ["page_id", *names])


def elements(pages: DataFrame) -> DataFrame:
    """page_id and ``ELEMENTS`` of every element of every page."""
    ship_package(pages.sparkSession)
    schema = T.StructType([pages.schema["page_id"], *T._parse_datatype_string(ELEMENTS).fields])
    return pages.select("page_id", "html").mapInArrow(lister, schema)


def records(listed: DataFrame) -> DataFrame:
    """page_id, record, first, last, depth: the records of each page's list, as ranges of elements, and how
    deep the list lies. ``listed``: stored elements."""
    children = listed.select("page_id", "parent", "pos", "last", "shape", "chars", "texts", F.size("path").alias("depth"), F.element_at("path", -1).alias("kind"))
    begins = children.groupBy("page_id", "parent", "kind").agg(F.count("*").alias("_n")).filter(F.col("_n") >= LEAST_RECORDS)
    list_of = ["page_id", "parent", "begin"]
    runs = children.join(begins.select("page_id", "parent", F.col("kind").alias("begin")), ["page_id", "parent"])
    number = F.sum((F.col("kind") == F.col("begin")).cast("int")).over(Window.partitionBy(*list_of).orderBy("pos"))
    runs = runs.withColumn("record", number).filter("record > 0")
    found = runs.groupBy(*list_of, "record").agg(
        F.min("pos").alias("first"), F.max("last").alias("last"), F.sum("chars").alias("chars"), F.sum("texts").alias("texts"), F.min("depth").alias("depth"),
        F.xxhash64(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("pos", "shape"))), lambda c: c["shape"]))).alias("shape"))
    alike = found.groupBy(*list_of, "shape").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.min("first").alias("at"), F.count_if(F.col("texts") > 1).alias("full"))
    lists = alike.groupBy(*list_of).agg(F.max("n").alias("most"), F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.min("at").alias("at"), F.sum("full").alias("full"))
    lists = lists.filter((F.col("most") >= LEAST_RECORDS) & (F.col("most") >= MOST * F.col("n")) & (F.col("full") >= MOST * F.col("n")))
    best = lists.groupBy("page_id").agg(F.max(F.struct(
        "chars", (F.col("most") / F.col("n")).alias("alike"), (-F.col("at")).alias("early"), "parent", "begin")).alias("best"))
    chosen = found.join(best.select("page_id", "best.parent", "best.begin"), list_of)
    return chosen.select("page_id", (F.col("record") - 1).cast("int").alias("record"), "first", "last", "depth")


def fields(listed: DataFrame, found: DataFrame) -> DataFrame:
    """page_id, record, pos, place, text: the texts of every record; ``place`` is the path below the list."""
    starts = found.select("page_id", F.col("first").alias("pos"), F.struct("record", "last", "depth").alias("r"))
    marked = listed.join(starts, ["page_id", "pos"], "left")
    within = F.last("r", ignorenulls=True).over(Window.partitionBy("page_id").orderBy("pos"))
    rows = marked.withColumn("r", within).filter("r is not null and pos <= r.last and own <> ''")
    below = F.expr("array_join(slice(path, r.depth, size(path)), '/')")
    return rows.select("page_id", "r.record", "pos", below.alias("place"), F.col("own").alias("text"))


def discovered_questions(pages: DataFrame) -> DataFrame:
    """``page_id, pos, enunciado, alternativas`` of the repeated records of ``pages`` (page_id, html)."""
    listed = durable(elements(pages), "elements")
    found = durable(records(listed), "records")
    texts = durable(fields(listed, found), "fields")
    sizes = found.groupBy("page_id").agg(F.count("*").alias("records"))
    per_record = texts.groupBy("page_id", "place", "record").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    places = per_record.groupBy("page_id", "place").agg(F.count("*").alias("has"), F.avg("n").alias("often"), F.avg("chars").alias("chars"))
    places = places.join(sizes, "page_id").filter(F.col("has") >= MOST * F.col("records"))

    def pick(rows: DataFrame, order: str, name: str) -> DataFrame:
        return rows.groupBy("page_id").agg(F.max(F.struct(order, "chars", "place")).alias("p")).select("page_id", F.col("p.place").alias(name))

    options = pick(places.filter("often >= 2"), "often", "option_place")
    statements = pick(places.filter("often < 2"), "chars", "statement_place")
    roles = texts.join(statements, "page_id").join(options, "page_id", "left")
    said = F.sort_array(F.collect_list(F.when(F.col("place") == F.col("statement_place"), F.struct("pos", "text"))))
    offered = F.sort_array(F.collect_list(F.when(F.col("place") == F.col("option_place"), F.struct("pos", "text"))))
    rows = roles.groupBy("page_id", "record").agg(said.alias("said"), offered.alias("offered"))

    def option(o, i):
        letter = F.regexp_extract(o["text"], LETTERED, 1)
        by_place = F.when(i < len(OPTION_LETTERS), F.substring(F.lit(OPTION_LETTERS), i + 1, F.lit(1)))
        return F.struct(F.coalesce(F.nullif(letter, F.lit("")), by_place).alias("key"), F.regexp_replace(o["text"], LETTERED, "").alias("value"))

    entries = F.filter(F.transform("offered", option), lambda e: e["key"].isNotNull())
    rows = rows.select("page_id", F.col("record").alias("pos"), F.array_join("said.text", " ").alias("enunciado"), entries.alias("entries"))
    keys = F.array_distinct("entries.key")
    first = F.transform(keys, lambda k: F.element_at(F.filter("entries", lambda e: e["key"] == k), 1)["value"])
    return rows.filter("enunciado <> ''").select("page_id", "pos", "enunciado", F.map_from_arrays(keys, first).alias("alternativas"))
