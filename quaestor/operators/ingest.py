"""Keyed writes: quarantine, insert-if-new under two unique keys, progress and usage
logs, answer and text updates. State is kept in append-only logs and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions import text
from quaestor.operators import conflicts
from quaestor.session import durable
from quaestor.sources.legacy import decode_legacy

# The sources a question may come from.
SOURCES = ["qconcursos", "quadrix_pdf", "pci"]

# values of the order column per bucket when numbering a table, and buckets per group
NUMBERING_WIDTH = 65_536
NUMBERING_GROUP = 65_536


def with_hashes(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "hash_enunciado": text.statement_hash("enunciado"),
            "content_hash": text.content_hash("enunciado", "alternativas"),
        }
    )


def reject_reason() -> Column:
    """NULL for a row that may be stored."""
    return (
        F.when(~F.coalesce(F.col("fonte").isin(SOURCES), F.lit(False)), "invalid_source")
        .when(F.coalesce(F.col("enunciado"), F.lit("")) == "", "no_statement")
        .when(F.coalesce(F.size("alternativas"), F.lit(0)) <= 0, "no_options")
    )


def valid_source() -> Column:
    return F.coalesce(F.col("fonte").isin(SOURCES), F.lit(False))


def complete(code: str = "id_qc") -> Column:
    """Code, statement and at least one option present."""
    return (
        (F.coalesce(F.col(code), F.lit("")) != "")
        & (F.coalesce(F.col("enunciado"), F.lit("")) != "")
        & (F.coalesce(F.size("alternativas"), F.lit(0)) > 0)
    )


def split_quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good, quarantine)``; quarantined rows carry ``motivo`` and never fail a job."""
    checked = rows.withColumn("motivo", reject_reason())
    return checked.filter("motivo is null").drop("motivo"), checked.filter("motivo is not null")


def not_stored(batch: DataFrame, bank: DataFrame, key: str = "content_hash") -> DataFrame:
    """Rows of the batch whose content the bank does not hold yet."""
    return batch.join(bank.select(key), key, "left_anti")


def _unknown_keys(pending: DataFrame, bank: DataFrame) -> DataFrame:
    """Pending keys the bank has neither by code nor by digest. ``pending`` is stored, so Spark
    knows its size and sends the smaller side."""
    return conflicts.without_codes(pending.join(bank.select("d"), "d", "left_anti"), bank)


def accepted_keys(
    batch: DataFrame, bank: DataFrame | None = None, *,
    seq: str = "seq", code: str = "id_qc", digest: str = "hash_enunciado",
) -> DataFrame:
    """``seq`` of every row that one-by-one insertion in ``seq`` order would store.

    A row is stored unless an earlier stored row has its code (when not NULL) or its
    digest. ``conflicts.accept`` settles who blocks whom in few rounds, however long the chains of
    rows that block each other.

    Only the narrow key columns take part. Copies (same code and digest, or same digest
    and no code) fold into one row by a partial aggregate before any shuffle, and the
    winners of a round are found between tables that have one row per key, joined on the
    unique ``seq``, so no hot key meets in one task there. The anti joins that drop the
    losers have one row per key on the right; a hot left key is split by adaptive
    execution.
    """
    keys = batch.select(F.col(seq).alias("s"), F.col(code).alias("c"), F.col(digest).alias("d"))
    pending = durable(keys.groupBy("c", "d").agg(F.min("s").alias("s")))
    if bank is not None:
        pending = durable(_unknown_keys(pending, bank.select(F.col(code).alias("c"), F.col(digest).alias("d"))))
    return conflicts.accept(pending).select(F.col("s").alias(seq))


def insert_status(batch: DataFrame, bank: DataFrame | None = None, *, seq: str = "seq", **keys) -> DataFrame:
    """The batch with ``status``: ``inserted`` or ``duplicate``. ``batch`` is read twice: pass a
    stored table where making it is dear."""
    won = accepted_keys(batch, bank, seq=seq, **keys).withColumn("_won", F.lit(True))
    return (
        batch.join(won, seq, "left")
        .withColumn("status", F.when(F.col("_won"), "inserted").otherwise("duplicate"))
        .drop("_won")
    )


def insert_if_new(batch: DataFrame, bank: DataFrame | None = None, *, seq: str = "seq", **keys) -> DataFrame:
    """The rows of the batch that get stored. The batch is stored first, so that it is made once."""
    batch = durable(batch, "batch")
    return batch.join(accepted_keys(batch, bank, seq=seq, **keys), seq, "left_semi")


def ingest_report(with_status: DataFrame, *keys: str) -> DataFrame:
    """Rows per key as ``inserted, duplicate, error`` columns."""
    counts = with_status.groupBy(*keys).agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("inserted", "duplicate", "error")]
    )
    return counts


def insert_else_fill(
    batch: DataFrame, bank: DataFrame, *, seq: str = "seq", agency: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(accepted, filled bank)``: rows that are not new offer their base text and
    images to the stored row with the same code."""
    rows = batch if agency is None else batch.withColumn("orgao", F.lit(agency))
    marked = insert_status(rows, bank, seq=seq)
    accepted = marked.filter("status = 'inserted'").drop("status")
    offers = marked.filter("status = 'duplicate'").select("id_qc", "texto_associado", "imagens", seq)
    return accepted, fill_associated_text(bank, offers, seq=seq)


def number_rows(rows: DataFrame, seq: str = "seq", start: int = 1, name: str = "id") -> DataFrame:
    """Consecutive ids in ``seq`` order without a global sort.

    ``seq`` is unique and integral, so a bucket of ``NUMBERING_WIDTH`` consecutive values
    never has more rows than that: rows are numbered inside their bucket and shifted by
    the number of rows in earlier buckets. Bucket sizes are summed in two levels, so that
    a sparse order column with very many buckets does not meet in one task either.
    """
    bucketed = rows.withColumn("_b", F.floor(F.col(seq) / NUMBERING_WIDTH))
    sizes = (
        bucketed.groupBy("_b").agg(F.count("*").alias("_n"))
        .withColumn("_g", F.floor(F.col("_b") / NUMBERING_GROUP))
    )
    # groups of groups: of those there are 65,536 at most, whatever the order column holds
    groups = sizes.groupBy("_g").agg(F.sum("_n").alias("_gn")).withColumn("_h", F.floor(F.col("_g") / NUMBERING_GROUP))
    before = Window.unboundedPreceding
    tops = groups.groupBy("_h").agg(F.sum("_gn").alias("_hn")).withColumn("_one", F.lit(1))
    tops = tops.select("_h", F.coalesce(F.sum("_hn").over(Window.partitionBy("_one").orderBy("_h").rowsBetween(before, -1)), F.lit(0)).alias("_hoff"))
    in_top = Window.partitionBy("_h").orderBy("_g").rowsBetween(before, -1)
    group_offsets = groups.withColumn("_goff", F.coalesce(F.sum("_gn").over(in_top), F.lit(0))).join(tops, "_h").select(
        "_g", (F.col("_goff") + F.col("_hoff")).alias("_goff"))
    in_group = Window.partitionBy("_g").orderBy("_b").rowsBetween(before, -1)
    offsets = (
        sizes.withColumn("_off", F.coalesce(F.sum("_n").over(in_group), F.lit(0)))
        .join(group_offsets, "_g")
        .select("_b", (F.col("_off") + F.col("_goff")).alias("_off"))
    )
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(seq))
    return (
        bucketed.join(offsets, "_b")
        .withColumn(name, (F.col("_off") + inside + (start - 1)).cast("bigint"))
        .drop("_b", "_off")
    )


def latest_progress(log: DataFrame) -> DataFrame:
    """Last page written per (source, key): the last write wins, not the highest page."""
    return log.groupBy("fonte", "chave").agg(F.max_by("pagina", "seq").alias("ultima_pagina"))


def used_ids(log: DataFrame) -> DataFrame:
    """Questions marked as used after the last reset. A reset is a row without a
    question id; its ``seq`` is found by an aggregate, not by sorting the log."""
    last_reset = log.filter("question_id is null").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("r"))
    return (
        log.filter("question_id is not null")
        .filter(F.col("seq") > last_reset.scalar())
        .select(F.col("question_id").alias("id"))
        .distinct()
    )


def with_used_flag(questions: DataFrame, log: DataFrame) -> DataFrame:
    used = used_ids(log).withColumn("_u", F.lit(1))
    return (
        questions.drop("usada").join(used, "id", "left")
        .withColumn("usada", F.coalesce("_u", F.lit(0))).drop("_u")
    )


def mark_used(exam_items: DataFrame, seq: Column) -> DataFrame:
    """Log rows to append after an exam was drawn."""
    return exam_items.select(
        F.col("id").alias("question_id"), F.col("exam").alias("exam_id"), seq.alias("seq")
    )


def _join_by_code(bank: DataFrame, updates: DataFrame) -> DataFrame:
    """The bank with what ``updates`` has for its code. Rows without a code are set apart, so that
    they don't meet under one key."""
    coded = bank.filter("id_qc is not null").join(updates, "id_qc", "left").select(*bank.columns, *[c for c in updates.columns if c != "id_qc"])
    return coded.unionByName(bank.filter("id_qc is null"), allowMissingColumns=True)


def set_answers(bank: DataFrame, updates: DataFrame) -> DataFrame:
    """Answer and comment by code. The last update wins and its NULL comment also
    overwrites."""
    last = (
        updates.groupBy("id_qc").agg(F.max_by(F.struct("gabarito", "comentario"), "seq").alias("u"))
        .filter("id_qc is not null")
    )
    hit = F.col("u").isNotNull()
    return (
        _join_by_code(bank, last)
        .withColumns(
            {
                name: F.when(hit, F.col("u")[name]).otherwise(F.col(name))
                for name in ("gabarito", "comentario")
            }
        )
        .drop("u")
    )


def fill_associated_text(bank: DataFrame, updates: DataFrame, seq: str = "seq") -> DataFrame:
    """Fill base text and images where the stored row has neither; the first non-empty
    offer per code counts. Adds ``preenchida``."""
    has_text = F.coalesce(F.col("texto_associado"), F.lit("")) != ""
    has_images = F.coalesce(F.size("imagens"), F.lit(0)) > 0
    offers = (
        updates.filter(F.col("id_qc").isNotNull() & (has_text | has_images))
        .groupBy("id_qc")
        .agg(
            F.min_by(
                F.struct(
                    F.nullif("texto_associado", F.lit("")).alias("t"),
                    F.when(has_images, F.col("imagens")).alias("i"),
                ),
                seq,
            ).alias("o")
        )
    )
    fill = F.col("o").isNotNull() & ~has_text & ~has_images
    joined = _join_by_code(bank, offers).withColumn("preenchida", fill)
    return joined.withColumns(
        {
            "texto_associado": F.when(F.col("preenchida"), F.col("o.t")).otherwise(F.col("texto_associado")),
            "imagens": F.when(F.col("preenchida"), F.col("o.i")).otherwise(F.col("imagens")),
        }
    ).drop("o")


def import_legacy(rows: DataFrame, bank: DataFrame | None = None, seq: str = "seq") -> DataFrame:
    """Decoded rows with ``status``: ``inserted``, ``duplicate`` or ``error``. A bad row
    never stops the others."""
    decoded = decode_legacy(rows)
    decoded = decoded.withColumn("erro", F.coalesce("erro", F.when(~valid_source(), "invalid_source")))
    decoded = durable(with_hashes(decoded), "legacy")  # decoded and hashed once
    bad = decoded.filter("erro is not null").withColumn("status", F.lit("error"))
    return insert_status(decoded.filter("erro is null"), bank, seq=seq).unionByName(bad)
