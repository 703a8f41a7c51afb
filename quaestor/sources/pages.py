"""Raw pages: ``page_id, url, html`` from Parquet or from saved HTML files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "page_id long, url string, html string"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGES).parquet(path)


def read_page_dumps(spark: SparkSession, path: str) -> DataFrame:
    """Saved ``*.html`` files, one page each. The id is a hash of the file path, so it
    does not depend on listing order."""
    files = spark.read.text(path, wholetext=True)
    return files.select(
        F.xxhash64(F.input_file_name()).alias("page_id"),
        F.input_file_name().alias("url"),
        F.col("value").alias("html"),
    )


def stream_pages(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
