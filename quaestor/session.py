"""Session settings and the helpers every multi-step job needs: cutting lineage durably,
computing costly columns once, shipping this package to the workers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # hot join keys: oversized shuffle partitions are split at run time
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "quaestor", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session, whose executors share the driver's disk, may fall
    back to a folder of its own.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="quaestor-"))
    return sc.getCheckpointDir().rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, for tables one job hands to the next."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


_STEPS: list[str] = []
# the list of a thread inside ``passing_steps``
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def _steps() -> list[str]:
    passing = _PASSING.get()
    return _STEPS if passing is None else passing


def delete_folder(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True))


def drop_steps(spark: SparkSession) -> int:
    """Delete the step tables that ``durable`` has made in this session so far; returns how many.
    To be called once the results made from them are written."""
    dropped, steps = 0, _steps()
    while steps:
        dropped += delete_folder(spark, steps.pop())
    return dropped


@contextmanager
def passing_steps(spark: SparkSession) -> Iterator[list[str]]:
    """Step tables made inside, in this thread, are deleted at the end."""
    token = _PASSING.set([])
    try:
        yield _steps()
    finally:
        drop_steps(spark)
        _PASSING.reset(token)


def durable(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from there: later steps
    neither recompute it nor depend on the executors that made it, read only the columns
    they need, and know its size."""
    path = work_path(df.sparkSession, label)
    _steps().append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(df: DataFrame, **columns) -> DataFrame:
    """Add costly columns so that they are computed once per row. Later filters and
    projections on them are not pushed through the one-row generator, whereas a plain
    projection would be merged into each of them and repeat the work."""
    packed = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(packed)))


#: bytes of rows that go to a Python worker at once. A task holds them outside the heap as they are
#: written (buffers grow by doubling) and as they come back, and its worker holds them twice
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application, for sessions
    that were not started with it in ``--py-files``. Rows go to them in batches of ``BATCH_BYTES``,
    where the session does not say otherwise."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="quaestor-")) / "quaestor.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)
