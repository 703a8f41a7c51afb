"""Neighbours in the order of an id, without a global sort into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.session import durable


def cyclic_predecessors(ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """``column``, ``before``: each distinct non-null id with the one before it; the smallest
    with the largest (an only one with itself).

    Ids are dealt by range, stored with the number of their part, and looked back within it;
    the first of each part takes the largest id of the parts before it, from a table with a row
    per part.
    """
    dealt = durable(ids.filter(F.col(column).isNotNull()).select(column).distinct()
                    .repartitionByRange(column).withColumn("part", F.spark_partition_id()), "ids")
    within = Window.partitionBy("part").orderBy(column)
    looked = dealt.withColumn("before", F.lag(column).over(within))
    parts = dealt.groupBy("part").agg(F.max(column).alias("largest")).withColumn("one", F.lit(1))
    in_order = Window.partitionBy("one").orderBy("part")
    parts = parts.withColumn("carried", F.coalesce(
        F.lag("largest").over(in_order), F.max("largest").over(Window.partitionBy("one")))).select("part", "carried")
    return looked.join(parts, "part").select(column, F.coalesce("before", "carried").alias("before"))
