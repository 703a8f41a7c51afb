"""Column functions that take structured pieces out of page text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaestor.functions.text import col

# The labels of a question's metadata line.
INFO_LABELS = r"(Ano|Banca|[ÓO]rg[ãa]o|Provas?):"

# Phrases and markup that flag a page's state.
NOT_FOUND_PHRASES = [
    "página não encontrada",
    "pagina nao encontrada",
    "não foi encontrada",
    "not found",
]
ACCOUNT_MODAL_ID = "js-account-not-confirm-modal"
LIMIT_MODAL_ID = "js-questions-limit-modal"
LIMIT_PHRASES = ["limite diário", "limite diario"]
ANSWER_BUTTON_CLASS = "js-answer-btn"
RIGHT_ANSWER_CLASS = "js-question-right-answer"
PRAISE_CLASS = "js-response-correct"


def _blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _text_of(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"(?U)\s+", " "))


def parse_origin(c: Column | str) -> Column:
    """``agency • board • year`` as struct; year is the first run of two or more digits
    in the third part."""
    parts = F.transform(F.split(col(c), "•"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    year = F.regexp_extract(F.get(parts, F.lit(2)), r"([0-9]{2,})", 1)
    return F.struct(
        _blank_to_null(F.get(parts, F.lit(0))).alias("orgao"),
        _blank_to_null(F.get(parts, F.lit(1))).alias("banca"),
        year.try_cast("int").alias("ano"),
    )


def parse_info(c: Column | str) -> Column:
    """Metadata line as map; a value ends where the next label starts. The last of
    repeated labels wins, empty values are left out."""
    text = col(c)
    labels = F.transform(
        F.regexp_extract_all(text, F.lit(INFO_LABELS), F.lit(1)),
        lambda k: F.when(F.startswith(k, F.lit("Prova")), F.lit("Prova")).otherwise(k),
    )
    # everything between two labels, the part before the first label dropped
    values = F.transform(
        F.slice(F.split(text, INFO_LABELS), 2, F.size(F.split(text, INFO_LABELS))),
        lambda v: F.regexp_replace(F.regexp_replace(v, r"(?U)^\s+|\s+$", ""), r"[ |]+$", ""),
    )
    pairs = F.filter(
        F.arrays_zip(labels.alias("k"), values.alias("v")), lambda p: p["v"] != ""
    )
    last_wins = F.filter(
        F.transform(
            pairs,
            lambda p, i: F.struct(
                p["k"].alias("key"),
                p["v"].alias("value"),
                F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]).alias("later"),
            ),
        ),
        lambda e: ~e["later"],
    )
    return F.map_from_entries(
        F.transform(last_wins, lambda e: F.struct(e["key"], e["value"]))
    )


def question_code(c: Column | str) -> Column:
    return _blank_to_null(F.regexp_extract(col(c), r"(Q[0-9]+)", 1))


def first_year(c: Column | str) -> Column:
    return F.regexp_extract(col(c), r"([0-9]{4})", 1).try_cast("int")


def image_urls(html: Column | str, site: str) -> Column:
    """Distinct absolute URLs of every ``img src`` and CSS ``background-image``."""
    tags = F.regexp_extract_all(col(html), F.lit(r"""(?i)<img\b[^>]*?\ssrc\s*=\s*["']([^"']+)["']"""), F.lit(1))
    styles = F.transform(
        F.regexp_extract_all(
            col(html), F.lit(r"""(?i)\sstyle\s*=\s*("[^"]*background-image[^"]*"|'[^']*background-image[^']*')"""), F.lit(1)
        ),
        lambda style: F.regexp_extract(style, r"""url\(\s*['"]?([^'")]+)['"]?\s*\)""", 1),
    )
    found = F.filter(F.concat(tags, styles), lambda u: u != "")
    return F.array_distinct(
        F.transform(
            F.transform(found, lambda u: F.replace(u, F.lit("&amp;"), F.lit("&"))),
            lambda u: F.when(F.startswith(u, F.lit("http")), u).otherwise(F.concat(F.lit(site), u)),
        )
    )


def answer_from_feedback(html: Column | str, marked: Column | str) -> Column:
    """Official letter when the feedback shows one, else the marked letter when the
    feedback praises it, else NULL."""
    page = col(html)
    tag = rf"""(?s)<(\w+)\b([^>]*class="[^"]*\b{RIGHT_ANSWER_CLASS}\b[^"]*"[^>]*)>(.*?)</\1>"""
    shown = _blank_to_null(_text_of(F.regexp_extract(page, tag, 3)))
    labelled = _blank_to_null(
        F.regexp_extract(F.regexp_extract(page, tag, 2), r'aria-label="\s*([^"]*)"', 1)
    )
    letter = F.upper(F.left(F.trim(F.coalesce(shown, labelled)), F.lit(1)))
    praised = page.rlike(rf'class="[^"]*\b{PRAISE_CLASS}\b')
    return F.when(letter.isin("A", "B", "C", "D", "E"), letter).when(
        praised & (col(marked) != ""), F.upper(col(marked))
    )


def page_not_found(html: Column | str) -> Column:
    return col(html).rlike("(?iu)" + "|".join(NOT_FOUND_PHRASES))


def account_blocked(html: Column | str) -> Column:
    return F.contains(col(html), F.lit(f'id="{ACCOUNT_MODAL_ID}"'))


def limit_reached(html: Column | str) -> Column:
    """The answer button says so, or the limit dialog (not the page at large) does."""
    page = col(html)
    button = page.rlike(
        rf'<button\b(?=[^>]*\b{ANSWER_BUTTON_CLASS}\b)(?=[^>]*data-limit-reached="true")'
    )
    dialog = F.lower(
        F.coalesce(
            _blank_to_null(F.regexp_extract(page, rf'(?s)id="{LIMIT_MODAL_ID}"[^>]*>(.*?)</div>', 1)),
            F.regexp_extract(
                page,
                r"(?s)<\w+\b(?=[^>]*data-limit-feedback=.resolveQuestionLimit.)"
                r'(?=[^>]*data-limit-reached="true")[^>]*>(.*?)</',
                1,
            ),
        )
    )
    said = F.lit(False)
    for phrase in LIMIT_PHRASES:
        said = said | F.contains(dialog, F.lit(phrase))
    return button | said


def answerable_ids(html: Column | str) -> Column:
    """Question numbers of all answer buttons on the page, each once."""
    ids = F.regexp_extract_all(
        col(html),
        F.lit(rf'<button\b(?=[^>]*\b{ANSWER_BUTTON_CLASS}\b)[^>]*data-question-id="([^"]+)"'),
        F.lit(1),
    )
    return F.array_distinct(ids)


def answer_disabled(html: Column | str) -> Column:
    """No answer button, or the first one switched off."""
    button = F.regexp_extract(col(html), rf"(<button\b[^>]*\b{ANSWER_BUTTON_CLASS}\b[^>]*>)", 1)
    return (button == "") | button.rlike(r'aria-disabled="true"|\sdisabled\b')
