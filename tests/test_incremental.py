"""Reports kept up by deltas, the bank laid out for draws, the index of statements."""

import random

from pyspark.sql import functions as F

from checks import projections as P
from quaestor.operators import draw, ingest
from quaestor.plans import stats
from quaestor.schemas import QUESTIONS
from quaestor.sources import clustered, logs, paged, text_index
from quaestor.streaming import reports

COLUMNS = "materia string, fonte string, categoria string, tema string, usada int, gabarito string, imagens_urls array<string>"


def question_rows(rng, n):
    return [(rng.choice(["a", "b", None]), rng.choice(["pci", "pci", "qconcursos"]), rng.choice(["c", "d", None]), rng.choice(["t", None]),
             rng.randint(0, 1), rng.choice(["A", None]), rng.choice([None, [], ["u"]])) for _ in range(n)]


def as_set(df):
    return sorted(map(str, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


def test_kept_reports_equal_the_batch_reports(spark, tmp_path, monkeypatch):
    """Twelve batches of additions and removals, with merges, a repeat and a batch that was not committed."""
    monkeypatch.setattr(reports, "FANOUT", 3)
    rng, out, held, state = random.Random(1), str(tmp_path / "cells"), [], None
    for batch in range(12):
        new = question_rows(rng, rng.randint(0, 30))
        gone = [held.pop(rng.randrange(len(held))) for _ in range(min(len(held), rng.randint(0, 12)))]
        held += new
        added, removed = spark.createDataFrame(new, COLUMNS), spark.createDataFrame(gone, COLUMNS)
        state = reports.add_batch(added, batch, out, removed=removed, state=state if batch % 2 else None)
        assert all(sum(level == at for _, level in state.folders) < 3 for at in range(4))
    assert reports.add_batch(spark.createDataFrame(held, COLUMNS), 11, out) == reports.read_state(spark, out)  # done already
    reports.cells_of(spark.createDataFrame(held, COLUMNS)).write.parquet(f"{out}/deltas/run=0/batch_id=12")  # never committed
    bank, cells = spark.createDataFrame(held, COLUMNS), reports.cells(spark, out).persist()
    assert as_set(reports.by_subject(cells)) == as_set(stats.by_subject(bank))
    for fonte in ("pci", "qconcursos", "none"):
        assert as_set(reports.source_status(cells, fonte)) == as_set(stats.source_status(bank, fonte))
        assert as_set(reports.source_tree(cells, fonte)) == as_set(stats.source_tree(bank, fonte)) or fonte == "none"


def test_clustered_draw_reads_few_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(clustered, "BUCKET_ROWS", 50)
    names = ["M 1", "é/2", None]
    bank = spark.range(3000).select("id").withColumns({
        f.name: F.lit(None).cast(f.dataType) for f in QUESTIONS.fields if f.name != "id"}).withColumns({
            "materia": F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("id") % 3 + 1).cast("int")),
            "content_hash": F.when(F.col("id") % 11 != 0, F.md5((F.col("id") % 2500).cast("string"))), "fonte": F.lit("pci"), "usada": (F.col("id") % 4 == 1).cast("int")})
    bank = bank.select(*[f.name for f in QUESTIONS.fields])
    path = str(tmp_path / "bank")
    clustered.write_clustered(bank, path)
    for n in (0, 7, 40, 600, 2000):
        requests = spark.createDataFrame([("e1", "M 1", n), ("e2", "é/2", n // 2), ("e3", "none", 5)], "exam string, materia string, n long")
        assert as_set(clustered.draw_clustered(spark, path, requests)) == as_set(draw.draw(bank, requests))
    few = spark.createDataFrame([("e1", "M 1", 40)], "exam string, materia string, n long")
    every = len(spark.read.parquet(f"{path}/questions").inputFiles())
    assert len(clustered.read_for(spark, path, few).inputFiles()) <= 2 < 40 < every


def test_index_equals_search(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK_IDS", 16)
    monkeypatch.setattr(text_index, "FIRST_BLOCKS", 2)
    rng = random.Random(4)
    words = ["lei", "Lei", "de", "a", "crase", "x", "é"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) if rng.random() < 0.95 else None) for i in range(600)]
    bank = spark.createDataFrame(rows, "id long, enunciado string")
    path = str(tmp_path / "index")
    for part in range(3):
        text_index.append_index(bank.filter(F.col("id") % 3 == part), path)
    for terms in (["lei"], ["LEI", "de"], ["crase", "a", "é", "lei"], ["none"], ["a", "none"]):
        want = draw.search_text(bank, terms).select("id", "score")
        assert as_set(text_index.search_index(spark, path, terms)) == as_set(want)
        for top in (1, 5, 1000):
            best = draw.search_text(bank, terms, top).select("id", "score")
            assert [tuple(r) for r in text_index.search_index(spark, path, terms, top).collect()] == [tuple(r) for r in best.collect()]


def test_index_search_prunes_terms(spark, sf_dir, tmp_path):
    path = str(tmp_path / "index")
    text_index.append_index(P.questions(spark, sf_dir), path)
    plan = text_index.search_index(spark, path, ["the"])._jdf.queryExecution().toString()
    assert "(bucket#" in plan and "PushedFilters: [IsNotNull(term)" in plan
    assert "enunciado" not in plan


def test_index_is_built_of_lists(spark, tmp_path, monkeypatch):
    """Terms are listed where the statements are: no posting is shuffled on its own, and a bucket is cut by blocks."""
    for name, value in (("BLOCK_IDS", 16), ("STRIPE_IDS", 64), ("PART_ROWS", 50), ("FILE_ROWS", 100)):
        monkeypatch.setattr(text_index, name, value)
    rows = [(i, None if i % 50 == 0 else "" if i % 50 == 1 else "lei  de" + " LEI" * (abs(i) % 3) + f" t{i}") for i in range(-200, 800)]
    bank, path = spark.createDataFrame(rows, "id long, enunciado string").repartition(7), str(tmp_path / "index")
    plan = text_index.lists_of(bank)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Sort" not in plan
    text_index.append_index(bank, path)
    stored = spark.read.parquet(f"{path}/lists")
    assert stored.filter("n <> size(ids) OR n <> size(tfs) OR most <> array_max(tfs) OR floor(array_min(ids) / 16) <> block OR floor(array_max(ids) / 16) <> block").isEmpty()
    places = stored.select("bucket", F.expr("pmod(block, 10)").alias("cut"), F.input_file_name().alias("file")).distinct()
    assert places.groupBy("bucket", "cut").count().filter("count > 1").isEmpty() and places.groupBy("file").count().filter("count > 1").isEmpty()
    per_term = {r["term"]: r for r in stored.groupBy("term").agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.max("most").alias("most")).collect()}
    assert per_term["lei"]["n"] == per_term["de"]["n"] == 960 and per_term["lei"]["most"] == 3 and per_term["lei"]["rows"] < 960 // 5
    assert per_term[""]["n"] == 20 and per_term["t-7"]["n"] == 1
    assert len(stored.filter("term = 'lei'").select(F.input_file_name()).distinct().collect()) > 4
    for terms in (["lei", "de"], ["t-7", "LEI"], [""]):
        assert as_set(text_index.search_index(spark, path, terms)) == as_set(draw.search_text(bank, terms).select("id", "score"))


def test_stream_restarts(spark, sf_dir, tmp_path):
    """Files that arrive later, under the same checkpoint."""
    source, out, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    bank = P.questions(spark, sf_dir)
    for part in range(2):
        bank.filter(F.col("id") % 2 == part).coalesce(1).write.mode("append").parquet(source)
        reports.maintain(spark.readStream.schema(bank.schema).parquet(source), out, offsets).awaitTermination()
    assert as_set(reports.by_subject(reports.cells(spark, out))) == as_set(stats.by_subject(bank))


def test_compacted_logs_read_like_plain_ones(spark, tmp_path, monkeypatch):
    """Histories with repeats and resets, an append that was never committed, and ones that compact."""
    monkeypatch.setattr(logs, "LEAST_ROWS", 12)
    rng, seq, progress, usage, compacted = random.Random(2), 0, [], [], 0
    for step in range(8):
        rows = []
        for _ in range(rng.randint(0, 15)):
            seq += 1
            rows.append((rng.choice(["pci", "q"]), rng.choice("abc"), rng.randint(0, 9), seq))
        progress += rows
        df = spark.createDataFrame(rows, "fonte string, chave string, pagina int, seq long")
        compacted += logs.append_log(df, str(tmp_path / "progress"), logs.reduce_progress)
        df.write.parquet(str(tmp_path / f"progress/rows/uncommitted{step}"))
        got = logs.read_log(spark, str(tmp_path / "progress"), df.schema)
        assert as_set(ingest.latest_progress(got)) == as_set(ingest.latest_progress(spark.createDataFrame(progress, df.schema)))
        assert got.count() <= 6 + 2 * 12 + 15
        rows = [(rng.choice([1, 2, 3, 4, 4, None if step % 3 == 2 else 5]), 7, seq * 100 + k) for k in range(rng.randint(0, 15))]
        usage += rows
        df = spark.createDataFrame(rows, "question_id long, exam_id long, seq long")
        compacted += logs.append_log(df, str(tmp_path / "usage"), logs.reduce_usage)
        got = logs.read_log(spark, str(tmp_path / "usage"), df.schema)
        assert as_set(ingest.used_ids(got)) == as_set(ingest.used_ids(spark.createDataFrame(usage, df.schema)))
    assert compacted >= 3


def test_pages_read_one_or_two_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(paged, "PART_ROWS", 50)
    rows = spark.range(1000).select((F.col("id") * 3).alias("id")).withColumns({
        f.name: F.lit(None).cast(f.dataType) for f in QUESTIONS.fields if f.name != "id"}).withColumns({
            "materia": F.when(F.col("id") % 5 == 0, "rare").when(F.col("id") < 900, "early").otherwise("late"), "categoria": F.lit("c")})
    rows = rows.select(*[f.name for f in QUESTIONS.fields])
    path = str(tmp_path / "paged")
    paged.write_paged(rows, path)
    for filters in ({}, {"materia": "rare"}, {"materia": "late", "categoria": "c"}, {"materia": "none"}):
        for where in ({}, {"skip": 137}, {"skip": 5000}, {"after_id": -1}, {"after_id": 1500}, {"after_id": 2996, "skip": 1}, {"after_id": 700, "skip": 60}):
            got = paged.page(spark, path, 20, **filters, **where)
            want = draw.browse(rows, **filters, **where, page_size=20)
            assert [r["id"] for r in got.collect()] == [r["id"] for r in want.collect()], (filters, where)
    cells = spark.read.parquet(f"{path}/counts")
    assert len(paged.parts_of_page(cells, 20, skip=730)[0]) <= 2 and len(paged.parts_of_page(cells, 20, after_id=1500)[0]) <= 2
