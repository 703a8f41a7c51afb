"""Running reports over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quaestor.plans import stats


def collection_rate(rows: DataFrame, width: str = "1 minute", delay: str | None = "10 minutes") -> DataFrame:
    """Rows per source and tumbling window. With a delay, rows later than the watermark
    are dropped; on a batch table pass ``None``."""
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    if delay:
        timed = timed.withWatermark("ts", delay)
    return (
        timed.groupBy(F.window("ts", width).alias("w"), "fonte")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("inicio"), "fonte", "n")
    )


def publish_snapshots(report: DataFrame, out: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Write every state of a running report to its own directory below ``out``."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        report.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def latest_snapshot(spark, out: str) -> DataFrame:
    """Last published state of a ``complete`` report."""
    rows = spark.read.parquet(out)
    newest = rows.agg(F.max("batch_id")).scalar()
    return rows.filter(F.col("batch_id") == newest).drop("batch_id")


def subject_statistics(questions: DataFrame) -> DataFrame:
    return stats.by_subject(questions)


def source_counts(questions: DataFrame) -> DataFrame:
    """Per source: total and classified rows (distinct counts are left to batch)."""
    return questions.groupBy("fonte").agg(
        F.count("*").alias("total"), F.count("categoria").alias("com_categoria")
    )
