"""What one task reads must not grow with the tables."""

import pytest
from pyspark.sql import functions as F

from checks import projections as P
from checks import registry
from quaestor.operators import classify
from quaestor.sources import clustered
from quaestor.streaming import ingest
from tests.test_plans import plan_of


@pytest.fixture
def plain(spark):
    """No broadcast by size, partitions as they are."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_texts_do_not_meet_by_subject_for_categories(spark, plain):
    rows = spark.range(10).select("id", F.when(F.col("id") >= 0, "en").alias("materia"), F.lit("the text").alias("enunciado"))
    keywords = spark.createDataFrame([("en", "c1", 1, ["the"])], "materia string, categoria string, cat_pos int, kws array<string>")
    plan = plan_of(classify.suggest_category(rows, keywords))
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2


def test_questions_do_not_meet_by_subject_for_a_layout(spark, sf_dir, plain, monkeypatch):
    monkeypatch.setattr(clustered, "BUCKET_ROWS", 20)
    bank = P.questions(spark, sf_dir)
    placed = clustered.placed_rows(bank)
    assert "SortMergeJoin" not in plan_of(placed)
    assert placed.count() == bank.count() and placed.select("subject", "bucket").distinct().count() > 8


def test_an_arrival_of_many_files_is_one_batch(spark, sf_dir, plain, monkeypatch):
    paths, work_path = [], registry.work_path
    monkeypatch.setattr(registry, "work_path", lambda spark, label: paths.append(work_path(spark, label)) or paths[-1])
    out = registry._ingested(spark, sf_dir, "'pci'")
    assert ingest.commits(spark, out).count() == 4
    arrived = next(path for path in paths if "/pages-in-" in path)
    assert len(spark.read.parquet(arrived).inputFiles()) > 8


def test_tables_are_dealt_to_more_tasks_as_they_grow(spark, sf_dir):
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
        docs = P.table(spark, sf_dir, "documents")
        dealt = P.spread(docs, "doc_id").rdd.getNumPartitions()
        assert dealt == 4 * docs.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)


def test_documents_meet_by_page_before_they_are_html(spark, sf_dir, plain):
    """One shuffle, of the documents, to as many tasks as the table asks for; nothing is stored before."""
    plan = plan_of(P.site_a_pages(spark, sf_dir))
    assert plan.count("Exchange") == 1 and "hashpartitioning(page_id" in plan and "Join" not in plan
    assert plan.index("Exchange") > plan.rindex("collect_list")
    blocks = P.site_a_pages(spark, sf_dir).select(F.explode(F.expr("regexp_extract_all(html, 'class=\"card sim-questao\"', 0)")))
    assert blocks.count() == P.table(spark, sf_dir, "documents").count()
