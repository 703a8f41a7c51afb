"""Splitting an exam's question count over subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def largest_remainder(
    specs: DataFrame, exam: str = "exam", quantity: str = "q", weight: str = "peso", order: str = "ordinal"
) -> DataFrame:
    """Add ``quota``: floor of the proportional share, the rest to the largest fractions,
    ties in listed order. All weights zero gives zero. Shares are IEEE doubles.

    A window partition is one exam, so it is as long as the exam's subject list.
    """
    whole = Window.partitionBy(exam)
    share = F.when(
        F.sum(weight).over(whole) != 0,
        (F.col(quantity) * F.col(weight)).cast("double") / F.sum(weight).over(whole).cast("double"),
    ).otherwise(0.0)
    parts = specs.withColumn("_share", share).withColumn("_base", F.floor("_share").cast("bigint"))
    parts = parts.withColumns(
        {
            "_frac": F.col("_share") - F.col("_base"),
            "_rest": F.when(F.sum(weight).over(whole) != 0, F.col(quantity) - F.sum("_base").over(whole)).otherwise(0),
        }
    )
    position = F.row_number().over(whole.orderBy(F.desc("_frac"), order))
    return parts.withColumn(
        "quota", F.col("_base") + F.when(position <= F.col("_rest"), 1).otherwise(0)
    ).drop("_share", "_base", "_frac", "_rest")


def rounded_quota(
    structure: DataFrame, exam: str = "exam", quantity: str = "q", weight: str = "qtd"
) -> DataFrame:
    """Keep the disciplines with a positive ``quota`` = share rounded half-even; the
    quotas need not sum to the quantity."""
    total = F.sum(weight).over(Window.partitionBy(exam))
    total = F.when(total == 0, 1).otherwise(total)
    quota = F.rint((F.col(quantity) * F.col(weight)).cast("double") / total.cast("double")).cast("bigint")
    return structure.withColumn("quota", quota).filter("quota > 0")


def redistribute(
    quotas: DataFrame, available: DataFrame, exam: str = "exam", quantity: str = "q",
    keys: tuple[str, ...] = ("materia",), order: str = "ordinal",
) -> DataFrame:
    """Add ``taken`` and ``extra``: what subjects short of questions leave over goes to
    the other subjects of the exam, largest quota first (ties in listed order), each as
    far as its questions last. Subjects that got nothing get no extra.

    ``available`` has the number of drawable questions (``disponiveis``) per key.
    """
    rows = quotas.join(available, list(keys), "left").withColumn(
        "disponiveis", F.coalesce("disponiveis", F.lit(0))
    )
    rows = rows.withColumn("taken", F.least(F.greatest("quota", F.lit(0)), "disponiveis"))
    rows = rows.withColumns(
        {
            "_spare": F.when(F.col("taken") > 0, F.col("disponiveis") - F.col("taken")).otherwise(0),
            "_short": F.col(quantity) - F.sum("taken").over(Window.partitionBy(exam)),
        }
    )
    earlier = (
        Window.partitionBy(exam).orderBy(F.desc("quota"), order).rowsBetween(Window.unboundedPreceding, -1)
    )
    left_over = F.col("_short") - F.coalesce(F.sum("_spare").over(earlier), F.lit(0))
    return rows.withColumn(
        "extra", F.greatest(F.lit(0), F.least("_spare", left_over)).cast("bigint")
    ).drop("_spare", "_short", "disponiveis")
