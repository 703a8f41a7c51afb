"""Incremental ingestion of page files with exactly-once results.

A store has a bank, a quarantine and a log of commits, each a table with a folder per run and
batch. A run is the life of one checkpoint; its name lies beside the checkpoint, so a new
checkpoint on the same store never meets the batch numbers of another. A batch is written to its
own folders, then committed: one small file with its progress, the highest id given out and the
segments of the key index. A batch that is repeated before its commit overwrites its folders with
the same rows; one that was committed already is not done again. Readers and later batches see
committed batches only.

A batch writes its parsed rows (deleted again at the end), bank, quarantine and commit. Of earlier
batches it reads the key buckets that its own keys fall into (``streaming.keys``)."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quaestor.operators import conflicts, draw, extract, ingest
from quaestor.schemas import QUESTIONS
from quaestor.session import delete_folder, durable, passing_steps
from quaestor.streaming import keys as index

CARRIED = ("categoria", "tema", "materia", "fonte")
#: a batch's row has a number; its other rows are progress
_COMMITS = f"number long, highest long, segments array<{index.SEGMENT}>, fonte string, chave string, pagina int, seq long"


def ordered(rows: DataFrame) -> DataFrame:
    """Rows with hashes and their ingest order: page, then place on the page, whatever numbers
    pages have."""
    return ingest.with_hashes(rows.withColumn("seq", F.struct("page_id", "pos")))


def page_questions(pages: DataFrame) -> DataFrame:
    """Storable rows of a batch of pages with their ingest order ``seq``. Expects
    ``page_id, html, categoria, tema, materia, fonte``."""
    return ordered(extract.questions_site_a(pages, carry=CARRIED))


def run_of(spark: SparkSession, checkpoint: str, out: str) -> str:
    """Name of the run that ``checkpoint`` stands for; made when it is new. A checkpoint that
    belongs to another store is refused."""
    path = f"{checkpoint.rstrip('/')}/store_run"
    fresh = spark.createDataFrame([(uuid.uuid4().hex, out.rstrip("/"))], "run string, store string").coalesce(1)
    fresh.write.mode("ignore").parquet(path)
    mine = spark.read.parquet(path).first()
    if mine["store"] != out.rstrip("/"):
        raise ValueError(f"checkpoint {checkpoint} belongs to the store {mine['store']}")
    return mine["run"]


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def _log(spark: SparkSession, out: str) -> DataFrame:
    return _table(spark, f"{out}/commits", f"{_COMMITS}, run string, batch_id long")


def commits(spark: SparkSession, out: str) -> DataFrame:
    return _log(spark, out).filter("number is not null").drop("fonte", "chave", "pagina", "seq")


def stored(spark: SparkSession, out: str, part: str) -> DataFrame:
    """Committed rows of a part of the store: ``bank``, ``quarantine`` or ``progress``."""
    if part == "progress":
        return _log(spark, out).filter("number is null").select("fonte", "chave", "pagina", "seq", "run", "batch_id")
    return spark.read.parquet(f"{out}/{part}").join(commits(spark, out).select("run", "batch_id"), ["run", "batch_id"], "left_semi")


@dataclass
class StoreState:
    """What the last commit says, kept by a running query from batch to batch."""

    number: int = 0
    highest: int = 0
    segments: list[index.Segment] = field(default_factory=list)
    done: int = -1  # last committed batch of this run


def read_state(spark: SparkSession, out: str, run: str, bank: DataFrame | None = None) -> StoreState:
    """The state of a store. A run's first batch also indexes ``bank``, once."""
    log = commits(spark, out)
    last = log.orderBy(F.desc("number")).first()
    mine = log.filter(F.col("run") == run).agg(F.max("batch_id")).first()[0]
    state = StoreState()
    if last is not None:
        state = StoreState(last["number"] + 1, last["highest"], [index.Segment(**s.asDict()) for s in last["segments"]])
    state.done = -1 if mine is None else mine
    if bank is not None and mine is None:
        given, highest = index.first_segment(bank.select("hash_enunciado", "id_qc", "id"), f"{out}/keys")
        state.segments = state.segments + given
        state.highest = max(state.highest, highest)
    return state


def _write(rows: DataFrame, out: str, part: str, run: str, batch_id: int) -> None:
    # overwriting the batch's own folder makes a repeated batch harmless
    rows.write.mode("overwrite").parquet(f"{out}/{part}/run={run}/batch_id={batch_id}")


def as_questions(rows: DataFrame, first_id: int, few: bool = False) -> DataFrame:
    """Rows in the shape of the question table, numbered on from ``first_id`` in the order of
    their digests, so that a repeated batch gets the same numbers and no task the whole batch
    unless its rows are ``few``."""
    if few:
        numbered = rows.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("content_hash", "hash_enunciado")))
    else:
        numbered = draw.rank_in_digest_order(rows.withColumn("id", F.lit(0)), ())
    have = {"id": F.col("rank") + (first_id - 1), "usada": F.lit(0)}
    columns = [
        (have[f.name] if f.name in have else F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in QUESTIONS.fields
    ]
    return numbered.select(*columns, "seq")


def parsed_rows(pages: DataFrame) -> DataFrame:
    """Rows of a batch of pages with ``motivo``, the reason why a row may not be stored; a page that
    cannot be read is such a row. Everything comes from one pass over the pages."""
    marked = extract.marked_pages(pages, "a", CARRIED)
    rows = ordered(extract.site_a_rows(extract.blocks_of(marked, "a", carry=CARRIED, faults=True), (*CARRIED, "fault")))
    unread = F.when(F.col("fault").isNotNull(), F.concat(F.lit("unreadable_page: "), "fault"))
    return rows.withColumn("motivo", F.coalesce(unread, ingest.reject_reason())).drop("fault")


def new_rows(good: DataFrame, count: int, segments: list[index.Segment]) -> DataFrame:
    """The rows of the batch that first-wins stores, given the stored keys."""
    spark = good.sparkSession
    mine = good.select(F.col("seq").alias("s"), F.col("id_qc").alias("c"), F.col("hash_enunciado").alias("d"))
    known = index.known_keys(spark, segments, index.keys_of(good))
    free = mine.join(known.filter("startswith(k, 'd')").select(F.substring("k", 2, 1 << 30).alias("d")), "d", "left_anti")
    free = conflicts.without_codes(free, known.filter("startswith(k, 'c')").select(F.substring("k", 2, 1 << 30).alias("c")))
    if count <= conflicts.TASK_ROWS:
        # made by one task and few: sent to the rows, which else join them in that task
        accepted = F.broadcast(conflicts.accept_few(free))
    else:
        accepted = conflicts.accept(durable(free.groupBy("c", "d").agg(F.min("s").alias("s")), "free"))
    return good.join(accepted.select(F.col("s").alias("seq")), "seq", "left_semi")


def store_batch(
    pages: DataFrame, batch_id: int, out: str, run: str = "0", bank: DataFrame | None = None, state: StoreState | None = None
) -> StoreState:
    """One micro-batch: parse, quarantine, insert what is new, log progress, commit; the state after it.
    ``bank`` is what was stored elsewhere before (question table); pages have ``CARRIED`` and
    ``pagina``, the number of the page in its list (without it: ``page_id``)."""
    spark = pages.sparkSession
    state = state or read_state(spark, out, run, bank)
    if batch_id <= state.done:
        return state
    with passing_steps(spark):
        parsed = durable(parsed_rows(pages), "parsed")
        count = parsed.agg(F.count_if(F.col("motivo").isNull()), F.count_if(F.col("motivo").isNotNull())).first()
        rows = new_rows(parsed.filter("motivo is null").drop("motivo"), count[0], state.segments)
        _write(as_questions(rows, state.highest + 1, count[0] <= conflicts.TASK_ROWS), out, "bank", run, batch_id)
        _write(parsed.filter("motivo is not null"), out, "quarantine", run, batch_id)
        folder = f"{out}/bank/run={run}/batch_id={batch_id}"
        added = spark.read.schema("id long, id_qc string").parquet(folder).agg(F.count("id"), F.count("id_qc"), F.max("id")).first()
        segments = state.segments + ([index.Segment(folder, 0, added[0] + added[1])] if added[0] else [])
        segments, gone = index.merged(spark, segments, f"{out}/keys")
        after = StoreState(state.number + 1, max(state.highest, added[2] or 0), segments, batch_id)
        page = F.col("pagina") if "pagina" in pages.columns else F.col("page_id").try_cast("int")
        progress = pages.groupBy("fonte", F.concat_ws("/", "categoria", "tema").alias("chave")).agg(F.max(page.cast("int")).alias("pagina"))
        commit = spark.createDataFrame([(state.number, after.highest, [s.as_row() for s in segments])], f"number long, highest long, segments array<{index.SEGMENT}>")
        log = commit.unionByName(progress.withColumn("seq", F.lit(state.number).cast("long")), allowMissingColumns=True)
        _write(log.select("number", "highest", "segments", "fonte", "chave", "pagina", "seq").coalesce(1), out, "commits", run, batch_id)
    for segment in gone:
        delete_folder(spark, segment.path)
    return after


def ingest_pages(pages: DataFrame, out: str, checkpoint: str, bank: DataFrame | None = None) -> StreamingQuery:
    """Start the ingestion and stop when all present files are stored. Restarting with
    the same checkpoint continues where it ended; with another one the store goes on as well.
    One query at a time writes to a store."""
    run = run_of(pages.sparkSession, checkpoint, out)
    held: list[StoreState | None] = [None]

    def store(rows: DataFrame, batch_id: int) -> None:
        held[0] = store_batch(rows, batch_id, out, run, bank, held[0])

    return (
        pages.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(store)
        .start()
    )


def drop_known_soon(questions: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Cheap pre-filter for repeated pages: drops a statement seen within the watermark.
    Insert-if-new stays the authority. Expects an event time ``ts``."""
    return questions.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["hash_enunciado"])
