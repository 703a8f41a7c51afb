"""Reading, appending, migrating and exporting the question table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaestor.functions import text
from quaestor.schemas import QUESTIONS


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Scan with a declared schema: no inference, pruned columns, pushed filters."""
    return spark.read.schema(QUESTIONS).parquet(path)


def read_questions_jdbc(
    spark: SparkSession, url: str, table: str, lower_id: int, upper_id: int,
    partitions: int, **options: str,
) -> DataFrame:
    """Scan a live database in ``id`` ranges, decoding its JSON text columns."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for key, value in options.items():
        reader = reader.option(key, value)
    rows = (
        reader.option("partitionColumn", "id")
        .option("lowerBound", str(lower_id))
        .option("upperBound", str(upper_id))
        .option("numPartitions", str(partitions))
        .load()
    )
    return decode_stored(rows)


def decode_stored(rows: DataFrame) -> DataFrame:
    """Stored form (JSON text, flag column name) to the typed question columns."""
    if "usada_em_simulado" in rows.columns:
        rows = rows.withColumnRenamed("usada_em_simulado", "usada")
    return rows.withColumns(
        {
            "alternativas": text.decode_options("alternativas"),
            "imagens": text.decode_list("imagens"),
            "imagens_urls": text.decode_list("imagens_urls"),
        }
    )


def encode_stored(rows: DataFrame) -> DataFrame:
    """Typed columns back to JSON text: an empty image list is stored as NULL, an
    empty URL list as ``[]``."""
    return rows.withColumns(
        {
            "alternativas": text.encode_json("alternativas"),
            "imagens": text.encode_json("imagens", null_when_empty=True),
            "imagens_urls": F.coalesce(text.encode_json("imagens_urls"), F.lit("[]")),
        }
    )


def append_questions(rows: DataFrame, path: str) -> None:
    """Append accepted rows, one directory per source so that source filters prune."""
    rows.write.mode("append").partitionBy("fonte").parquet(path)


def missing_columns(rows: DataFrame, wanted: T.StructType) -> list[str]:
    """Names required by ``wanted`` and absent from ``rows``, sorted."""
    return sorted(set(wanted.fieldNames()) - set(rows.columns))


def add_missing_columns(
    rows: DataFrame, wanted: T.StructType, defaults: dict[str, Column] | None = None
) -> DataFrame:
    """Add absent columns with their type and default (NULL if none is given).
    Present columns, also those outside ``wanted``, are left alone."""
    defaults = defaults or {}
    return rows.withColumns(
        {
            name: defaults.get(name, F.lit(None)).cast(wanted[name].dataType)
            for name in missing_columns(rows, wanted)
        }
    )


def merge_schemas(old: DataFrame, new: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Old and new rows as one table; columns either side lacks become NULL, then the
    default."""
    merged = old.unionByName(new, allowMissingColumns=True)
    return merged.withColumns(
        {name: F.coalesce(F.col(name), value) for name, value in (defaults or {}).items()}
    )


def export_rows(rows: DataFrame, where: Column | None = None) -> DataFrame:
    """Flat form for text formats: maps and arrays become JSON text."""
    kept = rows if where is None else rows.filter(where)
    nested = [f.name for f in kept.schema if isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))]
    return kept.withColumns({name: F.to_json(name) for name in nested})


def export_csv(rows: DataFrame, path: str, where: Column | None = None, compression: str = "gzip") -> None:
    (
        export_rows(rows, where)
        .write.mode("overwrite")
        .option("header", "true")
        .option("escape", '"')
        .option("quoteAll", "true")
        .option("compression", compression)
        .csv(path)
    )


def export_json(rows: DataFrame, path: str, where: Column | None = None, compression: str = "gzip") -> None:
    export_rows(rows, where).write.mode("overwrite").option("compression", compression).json(path)


def read_exported_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return (
        spark.read.schema(schema)
        .option("header", "true")
        .option("escape", '"')
        .option("multiLine", "true")
        .csv(path)
    )
