"""Pages to question rows. Tree-shaped pages go through Arrow batches in workers;
everything that a regular expression can say stays in column expressions."""

from __future__ import annotations

import html
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaestor.functions import parsing, text
from quaestor.operators.html_blocks import LAYOUTS as LAYOUTS_OF_SITES
from quaestor.operators.html_blocks import PAGE_BLOCKS, mark_pages, read_marks
from quaestor.schemas import BLOCKS
from quaestor.session import once, ship_package

# Fixed value: prefix of relative image addresses on site A.
SITE_A_IMAGES = "https://www.pciconcursos.com.br"

# Fixed value: the characters that Unicode calls white space.
SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed value: letters of options that carry none, by place.
OPTION_LETTERS = "ABCDE"


# A lambda's argument is put in wherever it is used, so whatever costs something is a step of its
# own: pieces cleaned, texts joined, fields and option entries read, options made a map. ``once``
# keeps the steps apart.

def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def _nodes(block: Column, role: str) -> Column:
    return F.filter(block["nodes"], lambda n: n["role"] == role)


def _first(nodes: Column) -> Column:
    return F.get(nodes, F.lit(0))


def _spaced(node: Column) -> Column:
    """Text of a marked node with runs of white space as one blank; NULL without a node."""
    return F.trim(F.regexp_replace(F.array_join(node["pieces"], " "), r"(?U)\s+", " "))


def _inside(block: Column, role: str, outer: str) -> Column:
    """Nodes of ``role`` inside the block's first node of role ``outer``."""
    at = F.array_position(F.transform(block["nodes"], lambda n: n["role"]), F.lit(outer)).cast("int") - 1
    return F.filter(_nodes(block, role), lambda n: F.array_contains(n["within"], at))


def _sources(nodes: Column) -> Column:
    return F.transform(F.filter(nodes, lambda n: n["value"] != ""), lambda n: n["value"])


def _last_wins(entries: Column) -> Column:
    """Map of array<struct<key,value>>, the last of equal keys kept at the place of the first."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]))


def _each_node(blocks: str, **fields) -> Column:
    """Blocks with the nodes' role, value, within and further ``fields``, functions of the node."""
    def node(n: Column) -> Column:
        return F.struct(*[n[c].alias(c) for c in ("role", "value", "within")], *[f(n).alias(name) for name, f in fields.items()])

    return F.transform(blocks, lambda b: F.struct(b["value"].alias("value"), F.transform(b["nodes"], node).alias("nodes")))


def _site_a_nodes(marked: DataFrame) -> DataFrame:
    """``text``: stripped pieces without separator."""
    marked = once(marked, _stripped=_each_node("blocks", pieces=lambda n: F.transform(n["pieces"], _strip)))
    return once(marked, _nodes=_each_node("_stripped", pieces=lambda n: n["pieces"], text=lambda n: F.array_join(n["pieces"], "")))


def _site_b_nodes(marked: DataFrame) -> DataFrame:
    """``text``: runs of white space as one blank."""
    return once(marked, _nodes=_each_node("blocks", text=_spaced))


def _site_a_fields(block: Column, site: str) -> dict[str, Column]:
    def option(n: Column) -> Column:
        rest = F.when(F.startswith(n["text"], n["value"]), F.substring(n["text"], F.length(n["value"]) + 1, F.length(n["text"]))).otherwise(n["text"])
        return F.struct(n["value"].alias("key"), _strip(rest).alias("value"))

    pieces = F.filter(_first(_nodes(block, "base_text"))["pieces"], lambda p: p != "")
    backgrounds = F.filter(F.transform(_nodes(block, "background"), lambda n: F.regexp_extract(n["value"], r"""url\(\s*['"]?([^'")]+)['"]?\s*\)""", 1)), lambda u: u != "")
    urls = F.transform(F.concat(_sources(_nodes(block, "image")), backgrounds), lambda u: F.when(F.startswith(u, F.lit("http")), u).otherwise(F.concat(F.lit(site), u)))
    return {
        "id_qc": block["value"],
        "enunciado": _first(_nodes(block, "statement"))["text"],
        "alternativas": F.transform(F.filter(_nodes(block, "option"), lambda n: n["value"] != ""), option),
        "materia_qc": F.lit(None).cast("string"),
        "assunto": F.lit(None).cast("string"),
        "origem": F.nullif(_first(_nodes(block, "origin"))["text"], F.lit("")),
        "texto_associado": F.coalesce(F.array_join(pieces, " "), F.lit("")),
        "imagens": _sources(_inside(block, "image", "base_text")),
        "imagens_urls": F.array_distinct(urls),
    }


def _site_b_fields(block: Column, site: str) -> dict[str, Column]:
    places = F.filter(F.transform(block["nodes"], lambda n, i: F.when(n["role"] == "option", i)), lambda i: i.isNotNull())

    def labelled(place: Column, number: Column) -> Column:
        letter = _first(F.filter(_nodes(block, "letter"), lambda n: F.array_contains(n["within"], place)))["text"]
        by_place = F.when(number < len(OPTION_LETTERS), F.substring(F.lit(OPTION_LETTERS), number + 1, F.lit(1)))
        return F.struct(letter.alias("letter"), by_place.alias("by_place"), F.get(block["nodes"], place)["text"].alias("text"))

    def option(o: Column) -> Column:
        found = F.when(F.length(o["letter"]) > 0, F.position(o["letter"], o["text"])).otherwise(F.lit(0))
        rest = F.when(found > 0, F.concat(F.substring(o["text"], F.lit(1), found - 1), F.substring(o["text"], found + F.length(o["letter"]), F.length(o["text"])))).otherwise(o["text"])
        return F.struct(F.coalesce(F.upper(F.substring(o["letter"], 1, 1)), o["by_place"]).alias("key"), _strip(rest).alias("value"))

    options = F.filter(F.transform(F.transform(places, labelled), option), lambda e: e["key"].isNotNull())  # beyond the fifth there is no letter
    links = F.transform(_inside(block, "link", "trail"), lambda n: n["text"])
    return {
        "id_qc": F.nullif(F.regexp_extract(F.coalesce(_first(_nodes(block, "code"))["text"], F.lit("")), r"(Q\d+)", 1), F.lit("")),
        "enunciado": _first(_nodes(block, "statement"))["text"],
        "alternativas": options,
        "materia_qc": F.get(links, F.lit(0)),
        "assunto": F.nullif(F.regexp_replace(F.get(links, F.lit(1)), r"[ ,]+$", ""), F.lit("")),
        "origem": F.nullif(_first(_nodes(block, "info"))["text"], F.lit("")),
        "texto_associado": F.coalesce(_first(_nodes(block, "base_text"))["text"], F.lit("")),
        "imagens": _sources(_inside(block, "image", "base_text")),
        "imagens_urls": F.array().cast("array<string>"),
    }


_SITES = {"a": (_site_a_nodes, _site_a_fields), "b": (_site_b_nodes, _site_b_fields)}


def marked_pages(pages: DataFrame, layout: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``page_id, carry, blocks, fault``: marked pieces of every page, or why it has none."""
    ship_package(pages.sparkSession)
    schema = T.StructType([pages.schema[c] for c in ("page_id", *carry)])
    schema = T.StructType([*schema.fields, *T._parse_datatype_string(f"blocks {PAGE_BLOCKS}, fault string").fields])
    return pages.select("page_id", *carry, "html").mapInArrow(mark_pages(layout, ["page_id", *carry]), schema)


def blocks_of(
    marked: DataFrame, layout: str, site: str = SITE_A_IMAGES, carry: tuple[str, ...] = (), faults: bool = False
) -> DataFrame:
    """``BLOCKS`` rows of marked pages: blocks with an id, a statement and an option. ``pos`` is
    the place among those of the page. With ``faults`` pages that could not be read have one row too,
    with nothing but their ``fault``."""
    nodes_of, fields_of = _SITES[layout]
    names = [f.name for f in BLOCKS.fields if f.name not in ("page_id", "pos")]
    read = once(nodes_of(marked), _fields=F.transform("_nodes", lambda b: F.struct(*[c.alias(n) for n, c in fields_of(b, site).items()])))
    read = once(read, read=F.transform("_fields", lambda q: F.struct(
        *[(_last_wins(q[n]) if n == "alternativas" else q[n]).alias(n) for n in names])))
    complete = lambda q: (q["id_qc"] != "") & (q["enunciado"] != "") & (F.size(q["alternativas"]) > 0)
    blocks, explode, kept = F.filter("read", complete), F.posexplode, list(carry)
    if faults:
        explode, kept = F.posexplode_outer, [*carry, "fault"]
        read = read.filter(F.col("fault").isNotNull() | (F.size("read") > 0))
    rows = read.select("page_id", *kept, explode(blocks).alias("pos", "q"))
    if faults:
        rows = rows.filter("q is not null or fault is not null")
    return rows.select(*[F.col(f.name) if f.name in ("page_id", "pos") else F.col(f"q.{f.name}") for f in BLOCKS.fields], *kept)


def page_blocks(
    pages: DataFrame, layout: str, site: str = SITE_A_IMAGES, carry: tuple[str, ...] = ()
) -> DataFrame:
    """``BLOCKS`` rows of every page. Page columns named in ``carry`` come along, which saves a
    join back to the pages. Pages that cannot be read have none; ``page_faults`` lists those."""
    return blocks_of(marked_pages(pages, layout, carry), layout, site, carry)


def page_faults(pages: DataFrame, layout: str) -> DataFrame:
    """``page_id, motivo`` of pages that the reader failed on."""
    return marked_pages(pages, layout).filter("fault IS NOT NULL").select("page_id", F.col("fault").alias("motivo"))


def questions_site_a(
    pages: DataFrame, site: str = SITE_A_IMAGES, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Blocks of site A with the origin line split into agency, board and year."""
    return site_a_rows(page_blocks(pages, "a", site, carry), carry)


def site_a_rows(blocks: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    rows = blocks.withColumn("_o", parsing.parse_origin("origem"))
    return rows.select(
        "page_id", "pos", "id_qc", "enunciado", "alternativas", "texto_associado", "imagens", "imagens_urls",
        F.col("_o.banca").alias("banca"), F.col("_o.orgao").alias("orgao"), F.col("_o.ano").alias("ano"),
        F.col("origem").alias("prova"), *carry,
    )


def questions_site_b(pages: DataFrame) -> DataFrame:
    """Blocks of site B with the metadata line taken apart."""
    rows = page_blocks(pages, "b").withColumn("_i", parsing.parse_info(F.coalesce("origem", F.lit(""))))
    return rows.select(
        "page_id", "pos", "id_qc", "enunciado", "alternativas", "materia_qc", "assunto",
        parsing.first_year(F.col("_i")["Ano"]).alias("ano"),
        F.col("_i")["Banca"].alias("banca"), F.col("_i")["Órgão"].alias("orgao"), F.col("_i")["Prova"].alias("prova"),
        "texto_associado", "imagens",
    )


def register_sql(spark: SparkSession) -> None:
    """``SELECT t.* FROM pages, LATERAL extract_questions(html) t`` for SQL users. The same rules
    as ``questions_site_a`` for one page at a time. A worker holds a hundred pages at once; an Arrow batch
    for a table function is bounded by rows alone, so it would hold a whole task's pages."""
    from pyspark.sql.functions import udtf

    ship_package(spark)

    @udtf(returnType="pos int, id_qc string, enunciado string, alternativas map<string,string>, origem string, "
          "texto_associado string, imagens array<string>", useArrow=False)
    class ExtractQuestions:
        def eval(self, page: str):
            pos = 0
            for block in read_marks(page or "", LAYOUTS_OF_SITES["a"]):
                by_role = {}
                for place, node in enumerate(block["nodes"]):
                    stripped = [p.strip() for p in node["pieces"]]
                    by_role.setdefault(node["role"], []).append((place, node, stripped))
                texts = {role: "".join(found[0][2]) for role, found in by_role.items()}
                options = {n["value"]: "".join(t).removeprefix(n["value"]).strip() for _, n, t in by_role.get("option", []) if n["value"]}
                if not (block["value"] and texts.get("statement") and options):
                    continue
                area, _, words = by_role.get("base_text", [(-1, None, [])])[0]
                images = [n["value"] for _, n, _ in by_role.get("image", []) if n["value"] and area in n["within"]]
                yield pos, block["value"], texts["statement"], options, texts.get("origin") or None, " ".join(filter(None, words)), images
                pos += 1

    spark.udtf.register("extract_questions", ExtractQuestions)


# --- unknown layouts by patterns --------------------------------------------

@dataclass(frozen=True)
class Layout:
    """How to cut a page into questions when only the look of the text is known."""

    start: str                      # a block starts where this matches
    statement: str                  # group 1
    option: str | None              # group 1 letter, group 2 text
    min_statement: int
    min_option: int = 0             # an option is longer than this
    min_options: int = 2
    answer: str | None = None       # group 1 letter
    comment: str | None = None      # group 1
    year: bool = False
    skip_head: bool = True          # what precedes the first start is no question
    not_starting: str | None = None


# The text patterns of the known page looks.
LAYOUTS = {
    "numbered": Layout(
        start=r"(?U)(?=\d+[.)])",
        statement=r"(?Us)^\d+[.)](.*?)(?=\n[A-E][.)]|\n?\z)",
        option=r"(?Umd)([A-E])\)?\s*([^\n]+?)(?=[A-E]\)|$)",
        min_statement=15,
        min_option=2,
        answer=r"(?U)[Gg](?:abarito|ab\.?)[:\s]+([A-E])",
    ),
    "containers": Layout(
        start=r"""(?Ui)(?=<div[^>]*class="[^"]*quest(?:ão|ion)[^"]*"[^>]*>)""",
        statement=r"(?Uis)<[^>]*(?:class|id)[^>]*enunciado[^>]*>(.+?)</",
        option=r"(?Uis)[A()\s]*([A-E])\s*[):\-]\s*(.+?)(?=[A-E]\s*[):\-]|\n?\z)",
        min_statement=10,
        min_option=-1,
        answer=r"(?U)[Gg]abarito[:\s]+([A-E])",
        comment=r"(?Us)[Cc]oment[áa]rio[:\s]+(.+?)(?=<(?:hr|br|div|p)|\n?\z)",
        year=True,
    ),
    "lines": Layout(
        start=r"\n",
        statement=r"(?Us)^\s*(\d+[.)]\s+.*)$",
        option=None,
        min_statement=16,
        min_options=0,
        skip_head=False,
        not_starting="[",
    ),
}


def _option_pairs(block: Column, layout: Layout) -> Column:
    """``array<struct<l,t>>``: letters and texts as found, tags stripped, short ones out."""
    # the block is searched once; a match is its letter and text again, up to where the text ends
    whole = layout.option[:layout.option.rindex("(?=")] + r"\z"
    found = F.regexp_extract_all(block, F.lit(layout.option), F.lit(0))
    cleaned = F.transform(found, lambda m: F.struct(
        F.upper(F.regexp_extract(m, whole, 1)).alias("l"), text.strip_tags(F.regexp_extract(m, whole, 2)).alias("t")))
    return F.filter(cleaned, lambda p: F.length(p["t"]) > layout.min_option)


def _last_per_letter(pairs: Column) -> Column:
    def last_of(letter):
        mine = F.filter(pairs, lambda p: p["l"] == letter)
        return F.struct(F.lit(letter).alias("key"), F.get(F.reverse(mine), F.lit(0))["t"].alias("value"))

    listed = F.array(*[last_of(letter) for letter in "ABCDE"])
    return F.map_from_entries(F.filter(listed, lambda e: e["value"].isNotNull()))


def questions_by_pattern(
    pages: DataFrame, layout: Layout, max_blocks: int | None = None, max_chars: int | None = None
) -> DataFrame:
    """``page_id, pos, enunciado, alternativas, gabarito, comentario, ano``. Whole texts
    and all blocks unless the caller asks for a preview."""
    blocks = pages.select("page_id", F.posexplode(F.split("html", layout.start)).alias("pos", "bloco"))
    if layout.skip_head:
        blocks = blocks.filter("pos > 0")
    statement = text.strip_tags(F.nullif(F.regexp_extract("bloco", layout.statement, 1), F.lit("")))
    rows = once(blocks, enunciado=statement).filter(F.length("enunciado") >= layout.min_statement)
    if layout.not_starting:
        rows = rows.filter(~F.startswith("enunciado", F.lit(layout.not_starting)))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    if layout.option:
        rows = once(rows, pares=_option_pairs(F.col("bloco"), layout))
        rows = once(rows, alternativas=_last_per_letter(F.col("pares")))
    else:
        rows = rows.withColumn("alternativas", empty)
    rows = rows.filter(F.size("alternativas") >= layout.min_options)

    def piece(pattern):
        if pattern is None:
            return F.lit(None).cast("string")
        return F.nullif(F.regexp_extract("bloco", pattern, 1), F.lit(""))

    rows = rows.select(
        "page_id", "pos", "enunciado", "alternativas",
        F.upper(piece(layout.answer)).alias("gabarito"),
        text.strip_tags(piece(layout.comment)).alias("comentario"),
        (parsing.first_year(F.concat("enunciado", "bloco")) if layout.year else F.lit(None).cast("int")).alias("ano"),
    )
    if max_chars:
        rows = rows.withColumn("enunciado", F.left("enunciado", F.lit(max_chars)))
    if max_blocks:
        order = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
        rows = rows.withColumn("_rn", order).filter(F.col("_rn") <= max_blocks).drop("_rn")
    return rows


# --- hierarchy discovery ------------------------------------------------------

_ANCHOR = r"""(?is)<a\b[^>]*?\shref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
_TOPIC = r'/simulados/([^/"?#]+)/([^/"?#]+)/([^/"?#]+)/?$'
_SUB = r'/simulados/([^/"?#]+)/([^/"?#]+)/?$'


def _unescape(c: Column) -> Column:
    """Character references, named and numeric, decoded. Most texts have none and stay in the
    JVM; the others go to a worker in Arrow batches."""
    @F.pandas_udf("string")
    def decoded(texts: pd.Series) -> pd.Series:
        return texts.map(html.unescape, na_action="ignore")

    return F.coalesce(decoded(F.when(F.contains(c, F.lit("&")), c)), c)


def links(pages: DataFrame) -> DataFrame:
    """``page_id, categoria, pos, href, texto`` for every link of existing pages."""
    found = F.arrays_zip(
        F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(1)).alias("h"),
        F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(2)).alias("t"),
    )
    rows = pages.filter(~parsing.page_not_found("html")).select(
        "page_id", "categoria", F.posexplode(found).alias("pos", "a")
    )
    return once(
        rows, href=_unescape(F.col("a.h")), texto=_unescape(text.strip_tags(F.col("a.t")))
    ).drop("a")


def hierarchy(pages: DataFrame) -> DataFrame:
    """One row per (page, subcategory, distinct topic link): ``sub_nome, sub_url`` come
    from whichever link named the subcategory first. A subcategory without topics has
    one row with a NULL topic. ``pages`` is ``page_id, categoria, html``."""
    under = F.contains("href", F.concat(F.lit("/simulados/"), F.col("categoria"), F.lit("/")))
    all_links = links(pages).filter(under)
    is_topic = F.regexp_extract("href", _TOPIC, 1) == F.col("categoria")
    is_sub = (F.regexp_extract("href", _SUB, 1) == F.col("categoria")) & ~is_topic
    named = all_links.filter(is_topic | is_sub).select(
        "page_id", "categoria", "pos", "href", "texto",
        F.when(is_topic, F.regexp_extract("href", _TOPIC, 2)).otherwise(F.regexp_extract("href", _SUB, 2)).alias("sub"),
        F.when(is_topic, F.regexp_extract("href", _TOPIC, 3)).alias("tema"),
    )
    first_name = F.when(F.col("tema").isNull(), F.col("texto")).otherwise(text.display_name("sub"))
    first_url = F.when(F.col("tema").isNull(), F.col("href")).otherwise(
        F.concat(F.lit("/simulados/"), F.col("categoria"), F.lit("/"), F.col("sub"))
    )
    # one row per distinct topic link, or one for the plain links of a subcategory
    distinct = named.withColumns({"nome": first_name, "url": first_url}).groupBy(
        "page_id", "categoria", "sub", "tema",
        F.when(F.col("tema").isNotNull(), F.col("href")).alias("tema_url"),
        F.when(F.col("tema").isNotNull(), F.col("texto")).alias("tema_nome"),
    ).agg(F.min("pos").alias("pos"), F.min_by("nome", "pos").alias("nome"), F.min_by("url", "pos").alias("url"))
    per_sub = Window.partitionBy("page_id", "categoria", "sub")
    ranked = distinct.withColumns(
        {
            "sub_pos": F.min("pos").over(per_sub),
            "sub_nome": F.min_by("nome", "pos").over(per_sub),
            "sub_url": F.min_by("url", "pos").over(per_sub),
            "_topics": F.count("tema").over(per_sub),
        }
    )
    return ranked.filter("tema is not null or _topics = 0").select(
        "page_id", "categoria", "sub", "sub_pos", "sub_nome", "sub_url", "tema", "tema_nome", "tema_url", "pos"
    )


def topic_urls(pages: DataFrame) -> DataFrame:
    """Flat topic to URL list per page; of equal topic slugs the last one wins."""
    return (
        hierarchy(pages).filter("tema is not null")
        .groupBy("page_id", "categoria", "tema")
        .agg(F.max_by("tema_url", F.struct("sub_pos", "pos")).alias("url"))
    )


def answer_states(pages: DataFrame) -> DataFrame:
    """``page_id, numero, id_questao, respondivel`` per question block of site B: the number of
    the question on the block's own answer button, and whether that button is there and on."""
    button = lambda b: _first(_nodes(b, "answer_button"))
    states = F.transform("blocks", lambda b: F.struct(
        F.nullif(F.regexp_extract(F.coalesce(_spaced(_first(_nodes(b, "code"))), F.lit("")), r"Q(\d+)", 1), F.lit("")).alias("numero"),
        F.nullif(button(b)["value"], F.lit("")).alias("id_questao"),
        (button(b).isNotNull() & (F.size(_nodes(b, "answer_off")) == 0)).alias("respondivel")))
    return marked_pages(pages, "b").select("page_id", F.explode(states).alias("s")).select("page_id", "s.*")


def page_flags(pages: DataFrame) -> DataFrame:
    """State of every page."""
    return pages.select(
        "page_id",
        parsing.page_not_found("html").alias("nao_encontrada"),
        parsing.account_blocked("html").alias("conta_bloqueada"),
        parsing.limit_reached("html").alias("limite_atingido"),
        parsing.answer_disabled("html").alias("botao_bloqueado"),
        parsing.answerable_ids("html").alias("respondiveis"),
    )
