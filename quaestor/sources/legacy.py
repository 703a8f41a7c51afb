"""Import of rows from an older database: optional columns, JSON text, wrong sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.functions import text
from quaestor.session import once

# Columns the older layout may lack.
OPTIONAL = {"comentario": "string", "texto_associado": "string", "imagens": "string"}


def decode_legacy(rows: DataFrame) -> DataFrame:
    """Typed rows plus ``erro``: NULL, or why the row cannot be imported."""
    full = rows.withColumns(
        {name: F.lit(None).cast(kind) for name, kind in OPTIONAL.items() if name not in rows.columns}
    )
    images_given = F.coalesce(F.col("imagens"), F.lit("")) != ""
    decoded = once(
        full,
        opcoes=text.decode_options("alternativas"),
        lista=F.from_json("imagens", "array<string>"),
    ).withColumn("fonte", text.corrected_source("fonte", "id_qc"))
    bad_options = F.col("opcoes").isNull() | (
        # a malformed object decodes to a map without entries
        (F.size("opcoes") == 0) & ~F.col("alternativas").rlike(r"^\s*\{\s*\}\s*$")
    )
    return decoded.withColumn(
        "erro",
        F.when(bad_options, "bad_options_json").when(images_given & F.col("lista").isNull(), "bad_images_json"),
    ).withColumns(
        {"alternativas": F.col("opcoes"), "imagens": F.col("lista")}
    ).drop("opcoes", "lista")
