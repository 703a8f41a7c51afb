"""Exam specifications, taxonomy and board structure from indented text files.

The files are YAML documents. Each is first brought into one form (``key: value`` lines, two
blanks per level, ``- item`` lists) by the YAML library where the workers have it; a file that is
no YAML, or all files without the library, are read as they stand, and ``file_faults`` tells
which. One file is one row; its lines are numbered and every line learns its parent keys by a
running ``last`` per indentation level inside that file, so many files are read in parallel
and each file is one bounded window partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaestor.schemas import EXAM_SPECS

_KEY_LINE = r"""^( *)(- )?(?:"([^"]*)"|'([^']*)'|([^\s:"'#-][^:"']*?))\s*:(?:\s+(.*))?$"""
_ITEM_LINE = r"^( *)- (.*)$"

_SPEC_FIELDS = ["nome", "banca", "ano", "orgao", "formato", "total_questoes", "tempo_minutos"]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``(arquivo, texto)``: file name without folder and ending, whole content."""
    return spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("arquivo"),
        F.col("value").alias("texto"),
    )


def _unquoted(c):
    """Scalar without quotes, or without a trailing comment when it is not quoted."""
    quoted = F.regexp_extract(c, r"""^\s*(?:"([^"]*)"|'([^']*)')""", 0)
    return F.when(quoted != "", F.regexp_replace(F.trim(quoted), r"""^["']|["']$""", "")).otherwise(
        F.trim(F.regexp_replace(c, r"(^|\s)#.*$", ""))
    )


def _in_one_form(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    try:
        import yaml
    except ImportError:
        for files in batches:
            yield files.assign(motivo=None)
        return

    class Blocks(yaml.SafeDumper):
        def increase_indent(self, flow=False, indentless=False):
            return super().increase_indent(flow, False)

    Blocks.add_representer(type(None), lambda dumper, _: dumper.represent_scalar("tag:yaml.org,2002:null", ""))

    def form(text):
        try:
            content = yaml.safe_load(text or "")
            if not isinstance(content, dict):
                return "", "no_keys"
            return yaml.dump(content, Dumper=Blocks, sort_keys=False, allow_unicode=True, default_flow_style=False, width=1 << 30), None
        except yaml.YAMLError as error:
            return text, "no_yaml: " + str(error).split("\n")[0]

    for files in batches:
        formed = [form(t) for t in files["texto"]]
        yield files.assign(texto=[t for t, _ in formed], motivo=[m for _, m in formed])


def in_one_form(files: DataFrame) -> DataFrame:
    """``arquivo, texto, motivo``: block form of every file, or why it is left as it stands."""
    return files.select("arquivo", "texto").mapInPandas(_in_one_form, "arquivo string, texto string, motivo string")


def file_faults(files: DataFrame, own_key: bool = True) -> DataFrame:
    """``arquivo, motivo`` of files that give nothing or not all: no YAML, no keys at all, or
    with ``own_key`` (exam files) no top key named like the file."""
    formed = in_one_form(files)
    named = flatten(files).filter((F.col("recuo") == 0) & (F.col("chave") == F.col("arquivo"))).select("arquivo").distinct()
    bad = formed.filter("motivo is not null").select("arquivo", "motivo")
    if not own_key:
        return bad
    other = formed.filter("motivo is null").join(named, "arquivo", "left_anti")
    return bad.unionByName(other.select("arquivo", F.lit("other_top_key").alias("motivo")))


def flatten(files: DataFrame, levels: int = 4) -> DataFrame:
    """One row per line: ``arquivo, linha, recuo, chave, valor, item, k0..k3`` where
    ``k<i>`` is the key in force at indentation ``2*i``."""
    lines = in_one_form(files).select(
        "arquivo", F.posexplode(F.split("texto", r"\r?\n")).alias("linha", "bruto")
    ).filter(~F.col("bruto").rlike(r"^\s*(#.*)?$"))
    key = F.coalesce(
        *[F.nullif(F.regexp_extract("bruto", _KEY_LINE, g), F.lit("")) for g in (3, 4, 5)]
    )
    parsed = lines.select(
        "arquivo",
        "linha",
        F.length(F.regexp_extract("bruto", r"^( *)", 1)).alias("recuo"),
        F.col("bruto").rlike(r"^ *- ").alias("item"),
        key.alias("chave"),
        _unquoted(
            F.when(key.isNotNull(), F.regexp_extract("bruto", _KEY_LINE, 6)).otherwise(
                F.regexp_extract("bruto", _ITEM_LINE, 2)
            )
        ).alias("valor"),
    )
    so_far = Window.partitionBy("arquivo").orderBy("linha").rowsBetween(Window.unboundedPreceding, 0)
    return parsed.withColumns(
        {
            f"k{i}": F.last(
                F.when((F.col("recuo") == 2 * i) & ~F.col("item"), F.col("chave")), ignorenulls=True
            ).over(so_far)
            for i in range(levels)
        }
    )


def exam_specs(files: DataFrame) -> DataFrame:
    """One row per (exam, job, subject). The exam key is the file name and must also be
    the top key of the file."""
    rows = flatten(files).filter(F.col("k0") == F.col("arquivo"))
    per_exam = Window.partitionBy("arquivo")
    per_job = Window.partitionBy("arquivo", "k2")
    in_job = (F.col("k1") == "cargos") & (F.col("recuo") == 6)
    numbers = {"ano", "total_questoes", "tempo_minutos"}
    fields = {
        f: F.max(F.when((F.col("recuo") == 2) & (F.col("chave") == f), F.col("valor"))).over(per_exam)
        for f in _SPEC_FIELDS
    }
    rows = rows.withColumns(
        {f: (v.try_cast("int") if f in numbers else v) for f, v in fields.items()}
    )
    rows = rows.withColumns(
        {
            "nivel": F.max(F.when(in_job & (F.col("chave") == "nivel"), F.col("valor"))).over(per_job),
            "vagas": F.max(F.when(in_job & (F.col("chave") == "vagas"), F.col("valor"))).over(per_job).try_cast("int"),
        }
    )
    subjects = rows.filter(
        (F.col("k1") == "cargos") & (F.col("k3") == "materias") & (F.col("recuo") == 8)
    )
    ordinal = F.row_number().over(Window.partitionBy("arquivo", "k2").orderBy("linha"))
    return subjects.select(
        F.col("arquivo").alias("concurso"),
        *_SPEC_FIELDS,
        F.col("k2").alias("cargo"),
        "nivel",
        "vagas",
        ordinal.cast("int").alias("ordinal"),
        F.col("chave").alias("materia"),
        F.col("valor").try_cast("double").alias("peso"),
    )


def with_fallback(specs: DataFrame, fallback: DataFrame) -> DataFrame:
    """Built-in specifications stand in only for exams that have no file."""
    return specs.unionByName(fallback.join(specs.select("concurso").distinct(), "concurso", "left_anti"))


def exams_available(expected: DataFrame, specs: DataFrame, fallback: DataFrame) -> DataFrame:
    """Expected exams that have a file or a built-in specification."""
    known = specs.select("concurso").union(fallback.select("concurso")).distinct()
    return expected.select("concurso").distinct().join(known, "concurso", "left_semi")


def taxonomy(files: DataFrame) -> DataFrame:
    """``materia, categoria, tema`` with positions in file order."""
    rows = flatten(files).filter("item and k1 is not null").select(
        "arquivo", "linha", F.col("k0").alias("materia"), F.col("k1").alias("categoria"), F.col("valor").alias("tema")
    )
    first = rows.withColumn("cat_linha", F.min("linha").over(Window.partitionBy("arquivo", "materia", "categoria")))
    return first.select(
        "materia",
        "categoria",
        "tema",
        F.dense_rank().over(Window.partitionBy("arquivo", "materia").orderBy("cat_linha")).alias("cat_pos"),
        F.row_number().over(Window.partitionBy("arquivo", "materia", "categoria").orderBy("linha")).alias("tema_pos"),
    )


def board_structure(files: DataFrame) -> DataFrame:
    """``banca, ordem, disciplina, qtd`` per board. The section used is the one named
    like the file, or the only one the file has."""
    rows = flatten(files).filter("k1 = 'estrutura_disciplinas_padrao' and recuo >= 4")
    entry = F.count_if("item").over(
        Window.partitionBy("arquivo").orderBy("linha").rowsBetween(Window.unboundedPreceding, 0)
    )

    def field(name):
        return F.max(F.when(F.col("chave") == name, F.col("valor")))

    parts = (
        rows.withColumn("entrada", entry)
        .groupBy("arquivo", "k0", "entrada")
        .agg(
            field("ordem").try_cast("int").alias("ordem"),
            field("nome").alias("disciplina"),
            field("quantidade_questoes").try_cast("int").alias("qtd"),
        )
    )
    own = F.max(F.col("k0") == F.col("arquivo")).over(Window.partitionBy("arquivo"))
    first = F.min("k0").over(Window.partitionBy("arquivo"))
    chosen = F.when(own, F.col("arquivo")).otherwise(first)
    return parts.withColumn("secao", chosen).filter("k0 = secao").select(
        F.col("arquivo").alias("banca"), "ordem", "disciplina", F.coalesce("qtd", F.lit(0)).alias("qtd")
    )


def conform(specs: DataFrame) -> DataFrame:
    """Cast to the declared specification schema, in its column order."""
    return specs.select(*[F.col(f.name).cast(f.dataType) for f in EXAM_SPECS])
