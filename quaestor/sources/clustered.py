"""A bank laid out for draws: by subject and digest, so that a draw reads only where its questions lie.

Draws take a subject's smallest content hashes, unused ones first. Hashes are uniform, so their
first four hex digits cut a subject into even buckets in hash order; a subject has as many, a
power of two, that one holds about ``BUCKET_ROWS`` questions. A bucket is a folder. A small table
says for each subject, use state and bucket how many contents can be drawn; its running sums name the
buckets that a request reaches into. Equal contents share a bucket, and the buckets read are, for
each use state, the first ones, so ranks among the rows read are ranks in the whole bank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaestor.operators import draw
from quaestor.schemas import QUESTIONS
from quaestor.session import durable

BUCKET_ROWS = 8_192
MOST_BUCKETS = 65_536
_PLACE = T.StructType([T.StructField("subject", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
_COUNTS = "materia string, usada int, subject int, bucket int, n long"


def bucket_of(buckets: Column) -> Column:
    """Place of a row's content hash among ``buckets`` even parts; rows without a hash are in the first."""
    head = F.coalesce(F.conv(F.left("content_hash", F.lit(4)), 16, 10).cast("long"), F.lit(0))
    return F.floor(head * buckets / MOST_BUCKETS).cast("int")


def placed_rows(bank: DataFrame) -> DataFrame:
    """``bank`` with subject and bucket."""
    # only subjects of several buckets, so one row for BUCKET_ROWS of the bank at most: sent to the bank, whose
    # whole rows else meet by subject, a few tasks for all of them
    rows = bank.groupBy("materia").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET_ROWS)
    wanted = F.pow(F.lit(2), F.ceil(F.log2(F.col("n") / BUCKET_ROWS))).cast("long")
    parts = rows.select("materia", F.least(wanted, F.lit(MOST_BUCKETS)).alias("buckets"))
    placed = bank.join(F.broadcast(parts), bank["materia"].eqNullSafe(parts["materia"]), "left")
    placed = placed.select(bank["*"], F.coalesce("buckets", F.lit(1)).alias("buckets"))
    # subjects go by a number, which is safe in a path; two that share one share folders, no more
    return placed.withColumns({"subject": F.pmod(F.xxhash64("materia"), F.lit(1 << 30)).cast("int"), "bucket": bucket_of(F.col("buckets"))}).drop("buckets")


def write_clustered(bank: DataFrame, path: str) -> None:
    """Write ``bank`` (question table) and its table of counts below ``path``."""
    dealt = placed_rows(bank).repartition("subject", "bucket").sortWithinPartitions("subject", "bucket", "content_hash")
    dealt.write.partitionBy("subject", "bucket").parquet(f"{path}/questions")
    stored = bank.sparkSession.read.schema(T.StructType([*QUESTIONS.fields, *_PLACE.fields])).parquet(f"{path}/questions")
    counts = draw.one_per_content(stored, "materia", "usada", "subject", "bucket").groupBy("materia", "usada", "subject", "bucket").agg(F.count("*").alias("n"))
    counts.write.parquet(f"{path}/counts")


def rows_of(spark: SparkSession, path: str, places: list[tuple[int, int]]) -> DataFrame:
    folders = [f"{path}/questions/subject={subject}/bucket={bucket}" for subject, bucket in places]
    return spark.read.schema(QUESTIONS).parquet(*folders) if folders else spark.createDataFrame([], QUESTIONS)


def reached(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """The folders (subject, bucket) that requests reach into: those in front of which fewer contents lie than asked for.
    ``asked``: materia and ``_most``."""
    before = Window.partitionBy("materia").orderBy("usada", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    summed = counts.join(asked, "materia").withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return summed.filter("_before < _most").select("subject", "bucket").distinct()


def read_for(spark: SparkSession, path: str, requests: DataFrame) -> DataFrame:
    """The rows of the bank that ``requests`` (materia, n) can draw, from their folders alone. The names of
    the folders come to the driver: a few for each subject asked for, as many as the requests' sizes need."""
    counts = spark.read.schema(_COUNTS).parquet(f"{path}/counts")
    places = reached(counts, draw.most_asked(requests, ("materia",))).toLocalIterator()
    return rows_of(spark, path, sorted((r["subject"], r["bucket"]) for r in places))


def draw_clustered(spark: SparkSession, path: str, requests: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``draw.draw`` on the bank at ``path``: the same rows, reading only the buckets they lie in."""
    requests = durable(requests, "requests")  # asked once for the folders, once for the draw
    return draw.draw(read_for(spark, path, requests), requests, carry=carry)
