"""Append-only logs that stay cheap to read: a compacted base and the newest rows.

Progress and usage are logs of which only the winning rows count. A log folder has rows in folders of
their own and a manifest, numbered versions of the list of live folders; the highest version
is the state. An append writes its rows, then the next version. Once the rows appended since the last
compaction outnumber the base, the whole log is reduced to its winning rows as a new base, again
followed by a version that lists it alone. A reader merges base and newest rows by the same rule
that reads a plain log, so the result is the same and reads touch base and tail only. A
crash before a version is written changes nothing. One writer at a time."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaestor.session import delete_folder

#: rows that are appended before a compaction is worth it, however small the base
LEAST_ROWS = 10_000
_LIVE = "array<struct<path:string,rows:bigint,base:boolean>>"
_MANIFEST = f"live {_LIVE}, version bigint"

Reduce = Callable[[DataFrame], DataFrame]


def reduce_progress(log: DataFrame) -> DataFrame:
    """The last written row per (source, key)."""
    last = log.groupBy("fonte", "chave").agg(F.max_by("pagina", "seq").alias("pagina"), F.max("seq").alias("seq"))
    return last.select(*log.columns)


def reduce_usage(log: DataFrame) -> DataFrame:
    """The last reset, and of each question used since then its last row."""
    reset = log.filter("question_id is null").agg(F.max("seq").alias("seq"))
    since = log.filter("question_id is not null").filter(F.col("seq") > F.coalesce(reset.scalar(), F.lit(-1)))
    others = [c for c in log.columns if c not in ("question_id", "seq")]
    last = since.groupBy("question_id").agg(*[F.max_by(c, "seq").alias(c) for c in others], F.max("seq").alias("seq"))
    marker = reset.filter("seq is not null").select(
        *[(F.col("seq") if c == "seq" else F.lit(None).cast(log.schema[c].dataType)).alias(c) for c in log.columns])
    return last.select(*log.columns).unionByName(marker)


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def live_folders(spark: SparkSession, path: str) -> tuple[int, list[dict]]:
    """Number of the newest version, and its folders."""
    if not _exists(spark, f"{path}/manifest"):
        return -1, []
    newest = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").orderBy(F.desc("version")).first()
    return (newest["version"], [f.asDict() for f in newest["live"]]) if newest else (-1, [])


def _commit(spark: SparkSession, path: str, version: int, live: list[dict]) -> None:
    row = spark.createDataFrame([(live,)], f"live {_LIVE}").coalesce(1)
    row.write.mode("overwrite").parquet(f"{path}/manifest/version={version}")
    # of the versions before, one is kept for readers that are just looking at it
    delete_folder(spark, f"{path}/manifest/version={version - 2}")


def _write(rows: DataFrame, path: str, base: bool) -> dict:
    folder = f"{path}/rows/{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    return {"path": folder, "rows": rows.sparkSession.read.schema(rows.schema).parquet(folder).count(), "base": base}


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Base and newest rows; any reader of a plain log reads them to the same result."""
    _, live = live_folders(spark, path)
    return spark.read.schema(schema).parquet(*[f["path"] for f in live]) if live else spark.createDataFrame([], schema)


def append_log(rows: DataFrame, path: str, reduce: Reduce) -> bool:
    """Append ``rows``; whether the log was compacted."""
    spark = rows.sparkSession
    version, live = live_folders(spark, path)
    live.append(_write(rows, path, False))
    _commit(spark, path, version + 1, live)
    base = sum(f["rows"] for f in live if f["base"])
    if sum(f["rows"] for f in live if not f["base"]) <= max(base, LEAST_ROWS):
        return False
    compact_log(spark, path, rows.schema, reduce)
    return True


def compact_log(spark: SparkSession, path: str, schema: T.StructType, reduce: Reduce) -> None:
    version, live = live_folders(spark, path)
    if not live:
        return
    base = _write(reduce(read_log(spark, path, schema)), path, True)
    _commit(spark, path, version + 1, [base])
    for old in live:
        delete_folder(spark, old["path"])
