import datetime

from pyspark.sql import functions as F

from checks import projections as P
from quaestor.operators import ingest
from quaestor.streaming import ingest as stream
from quaestor.streaming import keys as index
from quaestor.streaming import monitor

COLUMNS = "page_id long, html string, categoria string, tema string, materia string, fonte string"


def site_pages(spark, sf_dir):
    return P.site_a_pages(spark, sf_dir).selectExpr(
        "page_id", "html", "'c' AS categoria", "'t' AS tema", "'m' AS materia",
        "CASE WHEN page_id % 5 = 4 THEN 'outra' ELSE 'pci' END AS fonte",
    )


def run(spark, source, out, offsets):
    pages = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(source)
    stream.ingest_pages(pages, out, offsets).awaitTermination()


def test_restarts_and_many_batches_equal_one_batch(spark, sf_dir, tmp_path):
    """Files arrive in page order, in two runs with a restart between them."""
    source, out, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    pages = site_pages(spark, sf_dir).persist()
    top = pages.agg(F.max("page_id")).first()[0]
    pages.filter(F.col("page_id") <= top // 3).coalesce(1).write.mode("append").parquet(source)
    run(spark, source, out, offsets)
    before = spark.read.parquet(out + "/bank").count()
    for low, high in ((top // 3, 2 * top // 3), (2 * top // 3, top)):
        pages.filter((F.col("page_id") > low) & (F.col("page_id") <= high)).coalesce(1).write.mode("append").parquet(source)
        run(spark, source, out, offsets)
    run(spark, source, out, offsets)  # nothing new

    good, bad = ingest.split_quarantine(stream.page_questions(pages))
    want = {r["seq"] for r in ingest.insert_if_new(good).collect()}
    rows = spark.read.parquet(out + "/bank")
    assert {r["seq"] for r in rows.collect()} == want and rows.count() == len(want) > before > 0
    assert spark.read.parquet(out + "/quarantine").count() == bad.count() > 0


def test_repeated_batch_changes_nothing(spark, sf_dir, tmp_path):
    out = str(tmp_path / "out")
    pages = site_pages(spark, sf_dir).persist()
    first, second = pages.filter("page_id < 8"), pages.filter("page_id >= 8")
    stream.store_batch(first, 0, out)
    stream.store_batch(second, 1, out)
    once = sorted(r["seq"] for r in spark.read.parquet(out + "/bank").collect())
    stream.store_batch(second, 1, out)
    assert sorted(r["seq"] for r in spark.read.parquet(out + "/bank").collect()) == once


def test_late_rows_are_dropped(spark, tmp_path):
    source, out, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))

    def deliver(*minutes):
        rows = [(datetime.datetime(2024, 1, 1, 10, m), "pci") for m in minutes]
        spark.createDataFrame(rows, "ts timestamp, fonte string").coalesce(1).write.mode("append").parquet(source)
        stream_rows = spark.readStream.schema("ts timestamp, fonte string").parquet(source)
        monitor.publish_snapshots(monitor.collection_rate(stream_rows), out, offsets, "update").awaitTermination()

    deliver(0, 0, 30)
    deliver(25, 2)   # 25 is within ten minutes of 30, 2 is not
    rows = spark.read.parquet(out).groupBy("inicio").agg(F.max_by("n", "batch_id").alias("n")).collect()
    assert {r["inicio"].minute: r["n"] for r in rows} == {0: 2, 30: 1, 25: 1}


def test_live_statistics_follow_the_stream(spark, tmp_path):
    source, out, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    schema = "materia string, usada int, gabarito string"
    for rows in ([("a", 0, None), ("b", 1, "A")], [("a", 1, "B")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        live = monitor.subject_statistics(spark.readStream.schema(schema).parquet(source))
        monitor.publish_snapshots(live, out, offsets).awaitTermination()
    got = {r["materia"]: (r["total"], r["ineditas"], r["usadas"], r["sem_gabarito"]) for r in monitor.latest_snapshot(spark, out).collect()}
    assert got == {"a": (2, 1, 1, 1), "b": (1, 0, 1, 0)}


def test_source_counts_stream_plan(spark, tmp_path):
    rows = spark.readStream.schema("fonte string, categoria string").parquet(str(tmp_path))
    assert monitor.source_counts(rows).isStreaming


def test_new_checkpoint_given_bank_and_hashed_page_ids(spark, sf_dir, tmp_path):
    """A store that goes on under another checkpoint keeps all its rows; ids stay unique."""
    import pytest

    source, out, first, second = (str(tmp_path / n) for n in ("in", "out", "c1", "c2"))
    pages = site_pages(spark, sf_dir).withColumn("page_id", F.xxhash64("page_id")).persist()
    pages.coalesce(1).write.parquet(source)
    held = ingest.insert_if_new(P.questions(spark, sf_dir).filter("id % 5 = 0"), seq="id").persist()
    read = lambda: spark.readStream.schema(COLUMNS).parquet(source)
    stream.ingest_pages(read(), out, first, held).awaitTermination()
    rows = stream.stored(spark, out, "bank").collect()
    stream.ingest_pages(read(), out, second, held).awaitTermination()
    again = stream.stored(spark, out, "bank").collect()
    assert sorted(r["hash_enunciado"] for r in again) == sorted(r["hash_enunciado"] for r in rows) and rows
    assert len({r["id"] for r in rows}) == len(rows) and min(r["id"] for r in rows) > held.agg(F.max("id")).first()[0]
    assert not {r["hash_enunciado"] for r in rows} & {r["hash_enunciado"] for r in held.collect()}
    good, _ = ingest.split_quarantine(stream.page_questions(pages))
    want = ingest.insert_if_new(good, held.select("hash_enunciado", "id_qc"))
    assert {r["hash_enunciado"] for r in want.collect()} == {r["hash_enunciado"] for r in rows}
    with pytest.raises(ValueError):
        stream.ingest_pages(read(), out + "-other", first)


def test_progress_is_the_last_page_of_a_list(spark, sf_dir, tmp_path):
    out = str(tmp_path / "out")
    pages = site_pages(spark, sf_dir).withColumn("pagina", (F.col("page_id") + 1).cast("int"))
    stream.store_batch(pages.filter("page_id < 10"), 0, out)
    stream.store_batch(pages.filter("page_id between 10 and 11"), 1, out)
    last = {r["fonte"]: r["ultima_pagina"] for r in ingest.latest_progress(stream.stored(spark, out, "progress")).collect()}
    assert max(last.values()) == 12


def test_uncommitted_batches_are_not_seen(spark, sf_dir, tmp_path):
    out = str(tmp_path / "out")
    pages = site_pages(spark, sf_dir).persist()
    stream.store_batch(pages.filter("page_id < 6"), 0, out)
    before = stream.stored(spark, out, "bank").count()
    spark.read.parquet(f"{out}/bank/run=0/batch_id=0").write.parquet(f"{out}/bank/run=0/batch_id=1")
    assert stream.stored(spark, out, "bank").count() == before


# --- key index ---------------------------------------------------------------------

def bank_rows(spark, low, high):
    return spark.range(low, high).selectExpr("id", "sha2(cast(id AS string), 256) AS hash_enunciado", "IF(id % 5 = 0, NULL, concat('Q', id)) AS id_qc")


def keys_read(spark, segments, asked):
    """Rows that the index reads for ``asked``."""
    return index.known_keys(spark, segments, index.keys_of(asked)).count()


def test_key_index_reads_what_the_batch_touches(spark, tmp_path, monkeypatch):
    """Sixteen times the bank: all keys of the batch are found, and hardly more is read."""
    monkeypatch.setattr(index, "BUCKET_ROWS", 64)
    asked = bank_rows(spark, 50, 60).persist()
    read = {}
    for rows in (20_000, 320_000):
        segments, highest = index.first_segment(bank_rows(spark, 0, rows), str(tmp_path / str(rows)))
        assert highest == rows - 1 and sum(s.rows for s in segments) == rows + rows - rows // 5
        known = {r["k"] for r in index.known_keys(spark, segments, index.keys_of(asked)).collect()}
        assert {r["k"] for r in index.keys_of(asked).collect()} <= known
        read[rows] = len(known)
    assert read[320_000] < 2 * read[20_000] < 20 * 64 * 2 * 2


def test_segments_are_merged_and_stay_complete(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BUCKET_ROWS", 16)
    monkeypatch.setattr(index, "FANOUT", 3)
    live, seen = [], 0
    for batch in range(10):
        folder = str(tmp_path / f"bank{batch}")
        bank_rows(spark, 40 * batch, 40 * batch + 40).write.parquet(folder)
        live, gone = index.merged(spark, [*live, index.Segment(folder, 0, 72)], str(tmp_path / "keys"))
        seen += 40
        assert all(sum(s.level == level for s in live) < 3 for level in range(5))
        assert sum(s.rows for s in live) == 72 * (batch + 1) and all(s.level for s in gone)
        asked = bank_rows(spark, 0, seen + 7)
        known = {r["k"] for r in index.known_keys(spark, live, index.keys_of(asked)).collect()}
        assert known == {r["k"] for r in index.keys_of(bank_rows(spark, 0, seen)).collect()}
    assert {s.level for s in live} == {0, 2}


def test_step_tables_go_with_their_batch(spark, sf_dir, tmp_path):
    """Four tables a batch, and of those that are no result none is left."""
    import os

    from quaestor.session import shared_dir

    pages, out = site_pages(spark, sf_dir).persist(), str(tmp_path / "out")
    before = set(os.listdir(shared_dir(spark)))
    state = stream.store_batch(pages.filter("page_id < 8"), 0, out)
    state = stream.store_batch(pages.filter("page_id >= 8"), 1, out, state=state)
    assert set(os.listdir(shared_dir(spark))) == before and sorted(os.listdir(out)) == ["bank", "commits", "quarantine"]
    assert stream.read_state(spark, out, "0") == state and state.done == 1 and state.highest == stream.stored(spark, out, "bank").count()


def test_large_batches_are_decided_in_rounds(spark, sf_dir, tmp_path, monkeypatch):
    pages = site_pages(spark, sf_dir).persist()
    stream.store_batch(pages, 0, str(tmp_path / "few"))
    monkeypatch.setattr(stream.conflicts, "TASK_ROWS", 3)
    stream.store_batch(pages, 0, str(tmp_path / "many"))
    few, many = (sorted((r["seq"], r["id"]) for r in stream.stored(spark, str(tmp_path / n), "bank").collect()) for n in ("few", "many"))
    assert [s for s, _ in few] == [s for s, _ in many] and {i for _, i in few} == {i for _, i in many}
