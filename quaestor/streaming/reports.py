"""Reports on a growing bank without reading it again: stored partial counts, kept up by deltas.

The reports by subject, of a source and of its category tree are all sums over the same cells, the
combinations of subject, source, category and topic. A batch adds the cells of its new rows and
takes away those of rows that it replaces (an answer set, a question used), as signed counts.
Each batch writes its delta and a commit that lists the live folders; after ``FANOUT`` deltas of
a size class the folders of that class become one. Reports read those folders, never the bank.

A batch that is repeated before its commit overwrites its delta; after it, it does nothing.
Folders that no commit lists are not seen, those that a later commit no longer lists are deleted."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quaestor.plans import stats
from quaestor.session import delete_folder
from quaestor.streaming.ingest import _exists, run_of

FANOUT = 8
CELL = ("materia", "fonte", "categoria", "tema")
SUMS = ("total", "ineditas", "usadas", "sem_gabarito", "com_imagens")
CELLS = ", ".join([*(f"{c} string" for c in CELL), *(f"{c} long" for c in SUMS)])
_FOLDER = "struct<path:string,level:int>"
_COMMIT = f"run string, batch_id long, number long, folders array<{_FOLDER}>"


def cells_of(rows: DataFrame, sign: int = 1) -> DataFrame:
    """Signed counts of question rows per cell."""
    images = F.coalesce(F.size("imagens_urls"), F.lit(0)) > 0
    values = {
        "total": F.lit(1), "ineditas": (F.col("usada") == 0).cast("int"), "usadas": F.col("usada"),
        "sem_gabarito": F.col("gabarito").isNull().cast("int"), "com_imagens": images.cast("int"),
    }
    return rows.groupBy(*CELL).agg(*[(F.coalesce(F.sum(v), F.lit(0)) * sign).cast("long").alias(n) for n, v in values.items()])


def summed(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in SUMS])


@dataclass
class ViewState:
    number: int = 0
    folders: list[tuple[str, int]] = field(default_factory=list)  # path, level
    done: int = -1


def read_state(spark: SparkSession, out: str, run: str = "0") -> ViewState:
    if not _exists(spark, f"{out}/commits"):
        return ViewState()
    log = spark.read.schema(_COMMIT).parquet(f"{out}/commits")
    last = log.orderBy(F.desc("number")).first()
    mine = log.filter(F.col("run") == run).agg(F.max("batch_id")).first()[0]
    return ViewState(last["number"] + 1, [(f["path"], f["level"]) for f in last["folders"]], -1 if mine is None else mine)


def cells(spark: SparkSession, out: str, state: ViewState | None = None) -> DataFrame:
    """The committed counts; cells that nothing is left of are gone."""
    folders = [path for path, _ in (state or read_state(spark, out)).folders]
    rows = spark.read.schema(CELLS).parquet(*folders) if folders else spark.createDataFrame([], CELLS)
    return summed(rows).filter("total <> 0")


def add_batch(
    added: DataFrame, batch_id: int, out: str, run: str = "0", removed: DataFrame | None = None, state: ViewState | None = None
) -> ViewState:
    """Count ``added`` rows in and ``removed`` rows, as they were, out."""
    spark = added.sparkSession
    state = state or read_state(spark, out, run)
    if batch_id <= state.done:
        return state
    delta = cells_of(added)
    if removed is not None:
        delta = summed(delta.unionByName(cells_of(removed, -1)))
    path = f"{out}/deltas/run={run}/batch_id={batch_id}"
    delta.write.mode("overwrite").parquet(path)
    folders, gone, level = [*state.folders, (path, 0)], [], 0
    while len(mine := [p for p, at in folders if at == level]) >= FANOUT:
        merged = f"{out}/merged/{uuid.uuid4().hex}"
        summed(spark.read.schema(CELLS).parquet(*mine)).filter(" or ".join(f"{c} <> 0" for c in SUMS)).write.parquet(merged)
        folders = [(p, at) for p, at in folders if at != level] + [(merged, level + 1)]
        gone, level = gone + mine, level + 1
    commit = spark.createDataFrame([(state.number, [{"path": p, "level": at} for p, at in folders])], f"number long, folders array<{_FOLDER}>")
    commit.coalesce(1).write.mode("overwrite").parquet(f"{out}/commits/run={run}/batch_id={batch_id}")
    for old in gone:
        delete_folder(spark, old)
    return ViewState(state.number + 1, folders, batch_id)


def maintain(questions: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep the counts up with a stream of question rows; stops when all present files are counted."""
    run = run_of(questions.sparkSession, checkpoint, out)
    held: list[ViewState | None] = [None]

    def count(rows: DataFrame, batch_id: int) -> None:
        held[0] = add_batch(rows, batch_id, out, run, state=held[0])

    return (
        questions.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(count).start()
    )


# --- the reports, from cells -----------------------------------------------------------------

def by_subject(counts: DataFrame) -> DataFrame:
    return counts.groupBy("materia").agg(*[F.sum(c).alias(c) for c in ("total", "ineditas", "usadas", "sem_gabarito")])


def source_status(counts: DataFrame, fonte: str = "pci") -> DataFrame:
    of_source = stats.of_source(counts, fonte)
    classified = F.when(F.col("categoria").isNotNull(), F.col("total"))
    return of_source.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum(classified), F.lit(0)).alias("com_categoria"),
        F.countDistinct("categoria").alias("categorias_unicas"))


def source_tree(counts: DataFrame, fonte: str = "pci") -> DataFrame:
    of_source = stats.of_source(counts, fonte).groupBy("categoria", "tema").agg(F.sum("total").alias("n"), F.sum("com_imagens").alias("imgs"))
    return stats.tree_of(of_source)
