"""Column functions on question text. All are built-in expressions, so they stay
inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Control characters whose JSON escape contains a hex letter.
_HEX_LETTER_ESCAPES = ["000B", "000E", "000F", "001A", "001B", "001C", "001D", "001E", "001F"]

# Badge name and the total a bank must exceed (None: always shown).
BADGES = [
    ("Penalista", 10000),
    ("Leitor", 5000),
    ("Streaker", None),
    ("Sniper", 30000),
    ("Mestre", 50000),
    ("Finalista", 40000),
]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def normalize_text(c: Column | str) -> Column:
    """Runs of white space (any Unicode blank, and the separators U+001C..1F) become
    one blank; ends trimmed; lower case."""
    return F.lower(F.trim(F.regexp_replace(col(c), r"(?U)[\s\x1c-\x1f]+", " ")))


def statement_hash(c: Column | str) -> Column:
    return F.sha2(normalize_text(c), 256)


def _json_string(c: Column) -> Column:
    """One JSON string literal, non-ASCII kept, control escapes in lower-case hex."""
    boxed = F.to_json(F.array(c))
    plain = F.substring(boxed, F.lit(2), F.length(boxed) - 2)
    lowered = plain
    for code in _HEX_LETTER_ESCAPES:
        # an escape is preceded by an even number of backslashes
        lowered = F.regexp_replace(
            lowered, rf"(?<!\\)((?:\\\\)*)\\u{code}", rf"$1\\u{code.lower()}"
        )
    return F.when(c.rlike(r"[\x0b\x0e\x0f\x1a-\x1f]"), lowered).otherwise(plain)


def canonical_options(options: Column | str) -> Column:
    """Options as JSON text with sorted keys and ``", "`` / ``": "`` separators, the
    form under which stored content hashes were computed."""
    pairs = F.transform(
        F.array_sort(F.map_entries(col(options))),
        lambda e: F.concat(_json_string(e["key"]), F.lit(": "), _json_string(e["value"])),
    )
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def content_hash(statement: Column | str, options: Column | str) -> Column:
    return F.md5(F.concat(normalize_text(statement), F.lit("|"), canonical_options(options)))


def encode_json(c: Column | str, null_when_empty: bool = False) -> Column:
    value = col(c)
    text = F.to_json(value)
    return F.when(F.size(value) > 0, text) if null_when_empty else text


def decode_options(c: Column | str) -> Column:
    """NULL for text that is not a JSON object (the caller quarantines those)."""
    return F.from_json(col(c), "map<string,string>")


def decode_list(c: Column | str) -> Column:
    return F.coalesce(F.from_json(col(c), "array<string>"), F.array().cast("array<string>"))


def slug(c: Column | str) -> Column:
    return F.translate(F.lower(col(c)), " _", "--")


def file_slug(c: Column | str, max_chars: int | None = None) -> Column:
    """File-name form: lower case, blanks to ``_``, commas and brackets dropped."""
    name = F.translate(F.lower(col(c)), " ,()", "_")
    return F.left(name, F.lit(max_chars)) if max_chars else name


def display_name(c: Column | str) -> Column:
    return F.initcap(F.replace(col(c), F.lit("-"), F.lit(" ")))


def shown_upper(c: Column | str) -> Column:
    return F.upper(F.replace(col(c), F.lit("_"), F.lit(" ")))


def options_in_order(options: Column | str) -> Column:
    """``array<struct<letra,texto>>`` ordered by letter."""
    return F.transform(
        F.array_sort(F.map_entries(col(options))),
        lambda e: F.struct(e["key"].alias("letra"), e["value"].alias("texto")),
    )


def provenance(banca: Column | str, orgao: Column | str, ano: Column | str, assunto: Column | str) -> Column:
    """``board · agency · year · topic``, empty parts left out (year 0 counts as empty)."""
    year = F.nullif(col(ano), F.lit(0)).cast("string")
    return F.concat_ws(" · ", _filled(col(banca)), _filled(col(orgao)), year, _filled(col(assunto)))


def suggested_minutes(n: Column | str) -> Column:
    return col(n) * 3


def corrected_source(fonte: Column | str, id_qc: Column | str) -> Column:
    """Rows filed under ``quadrix_pdf`` that carry a question code came from ``pci``."""
    wrong = (col(fonte) == "quadrix_pdf") & col(id_qc).isNotNull()
    return F.when(wrong, F.lit("pci")).otherwise(col(fonte))


def page_url(base: Column | str, page: Column | str) -> Column:
    """First page without a number, later ones with ``/n``."""
    return F.when(col(page) == 1, col(base)).otherwise(
        F.concat(col(base), F.lit("/"), col(page).cast("string"))
    )


def search_page_url(base: Column | str, page: Column | str) -> Column:
    joiner = F.when(F.contains(col(base), F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    return F.concat(col(base), joiner, F.lit("page="), col(page).cast("string"))


def strip_tags(c: Column | str, max_chars: int | None = None) -> Column:
    """Text without tags, trimmed; cut only when the caller asks for a preview."""
    text = F.regexp_replace(F.regexp_replace(col(c), r"<[^>]+>", ""), r"(?U)^\s+|\s+$", "")
    return F.left(text, F.lit(max_chars)) if max_chars else text


def percent(part: Column | str, whole: Column | str, when_empty: Column | float = 0.0) -> Column:
    """100·part/whole to one decimal, half-even; ``when_empty`` where whole is not positive."""
    empty = when_empty if isinstance(when_empty, Column) else F.lit(float(when_empty))
    return F.when(col(whole) > 0, F.bround(100.0 * col(part) / col(whole), 1)).otherwise(empty)


def progress_band(pct: Column | str) -> Column:
    p = F.coalesce(col(pct), F.lit(0.0))
    return F.when(p == 0, "danger").when(p < 50, "warning").otherwise("success")


def experience_points(total: Column | str) -> Column:
    return F.floor(col(total) / 10).cast("bigint")


def badges(total: Column | str) -> Column:
    """``array<struct<badge,unlocked>>`` for a bank total."""
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("badge"),
                (F.lit(True) if limit is None else col(total) > limit).alias("unlocked"),
            )
            for name, limit in BADGES
        ]
    )
