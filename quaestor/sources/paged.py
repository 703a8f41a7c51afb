"""A bank in ranges of ids, for pages that don't sort it.

Rows are dealt by id into parts of about ``PART_ROWS`` rows, a folder each, sorted. A small table has
for each part and each subject, category and topic how many rows there are and between which ids.
A page asks that table in which parts its rows lie and reads these: one or two for a page of usual
size, for the offset form too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.operators import draw
from quaestor.schemas import QUESTIONS

PART_ROWS = 65_536
_CELLS = "part int, materia string, categoria string, tema string, n long, low long, high long"


def write_paged(bank: DataFrame, path: str) -> None:
    """Write ``bank`` (question table) and its table of counts below ``path``."""
    parts = max(1, -(-bank.count() // PART_ROWS))
    dealt = bank.repartitionByRange(parts, "id").sortWithinPartitions("id").withColumn("part", F.spark_partition_id())
    dealt.write.partitionBy("part").parquet(f"{path}/questions")
    stored = bank.sparkSession.read.parquet(f"{path}/questions")
    cells = stored.groupBy("part", "materia", "categoria", "tema").agg(
        F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
    cells.coalesce(1).write.parquet(f"{path}/counts")


def _wanted(materia: str | None, categoria: str | None, tema: str | None) -> Column:
    wanted = F.lit(True)
    for name, value in (("materia", materia), ("categoria", categoria), ("tema", tema)):
        if value:
            wanted = wanted & (F.col(name) == value)
    return wanted


def parts_of_page(cells: DataFrame, page_size: int, after_id: int | None = None, skip: int = 0) -> tuple[list[int], int]:
    """The parts that hold the page, in order, and how many rows of them come before it. ``cells``:
    filtered counts; a row for each part comes to the driver until the page is full."""
    rows = cells.groupBy("part").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    if after_id is not None:
        rows = rows.filter(F.col("high") > after_id)
    parts, passed, held = [], 0, 0
    for row in rows.orderBy("part").toLocalIterator():
        whole = after_id is None or row["low"] > after_id
        if not parts and whole and row["n"] <= skip - passed:
            passed += row["n"]  # all of this part is skipped
            continue
        parts.append(row["part"])
        held += row["n"] if whole else 0  # of a part that the page begins in, perhaps nothing counts
        if held >= skip - passed + page_size:
            break
    return parts, passed


def page(
    spark: SparkSession, path: str, page_size: int, materia: str | None = None, categoria: str | None = None,
    tema: str | None = None, after_id: int | None = None, skip: int = 0,
) -> DataFrame:
    """The same rows as ``draw.browse`` on the bank at ``path``."""
    cells = spark.read.schema(_CELLS).parquet(f"{path}/counts").filter(_wanted(materia, categoria, tema))
    parts, passed = parts_of_page(cells, page_size, after_id, skip)
    if not parts:
        return spark.createDataFrame([], QUESTIONS)
    rows = spark.read.schema(QUESTIONS).parquet(*[f"{path}/questions/part={p}" for p in parts])
    return draw.browse(rows, materia, categoria, tema, after_id, page_size, skip - passed)
