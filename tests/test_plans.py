"""Plan shapes that have to hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

from checks import projections as P
from checks.registry import QUERIES
from quaestor.operators import conflicts, draw, ingest
from quaestor.plans import stats

STREAMS = {n for n in QUERIES if re.match(r"st[1235]_|st4_coll", n)}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in STREAMS])
def test_no_cross_joins(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_only_needed_columns_and_partitions(spark, sf_dir):
    plan = plan_of(stats.source_tree(P.questions(spark, sf_dir)))
    schema = re.search(r"ReadSchema: struct<([^>]*(?:<[^>]*>)?[^>]*)>", plan).group(1)
    assert "enunciado" not in schema and "alternativas" not in schema
    assert re.search(r"PartitionFilters: \[.*fonte.*pci", plan)


def test_requests_of_any_size_have_one_plan_and_schema(spark, sf_dir):
    rows = P.questions(spark, sf_dir)
    small, large = draw.rank_candidates(rows, 900), draw.rank_candidates(rows, 5000)
    assert small.schema == large.schema and dict(large.dtypes)["rank"] == "bigint"
    assert {tuple(r) for r in large.collect()} == {tuple(r) for r in small.collect()}


def test_a_large_request_makes_no_more_rows_than_it_gets(spark):
    bank = spark.range(3000).select(
        "id", F.lit("pci").alias("fonte"), F.when(F.col("id") >= 0, "m").alias("materia"), F.lit(0).alias("usada"), F.md5(F.col("id").cast("string")).alias("content_hash"))
    requests = spark.range(200).select(F.col("id").alias("exam"), F.when(F.col("id") >= 0, "m").alias("materia"), F.when(F.col("id") == 0, 1500).otherwise(1).alias("n"))
    drawn = draw.draw(bank, requests)
    assert drawn.count() == 1500 + 199 and drawn.filter("exam = 0").agg(F.countDistinct("id")).first()[0] == 1500
    plan = plan_of(drawn)
    assert "_n" not in re.findall(r"Filter \(.*", plan) and "BroadcastNestedLoopJoin" not in plan


def test_any_id_comes_back_unchanged(spark):
    rows = spark.createDataFrame([(-5, "pci", "a"), (2**60 + 7, "qconcursos", "a"), (9, "qconcursos", "b"), (-9, "other", "b"), (-(2**62), None, "c")], "id long, fonte string, content_hash string")
    assert {r["content_hash"]: r["id"] for r in draw.one_per_content(rows).collect()} == {"a": 2**60 + 7, "b": 9, "c": -(2**62)}


def test_copies_fold_before_the_shuffle(spark):
    """A third of all rows is one content: each task sends one row of it."""
    rows = spark.range(0, 90_000, 1, 6).select(
        "id", F.lit("pci").alias("fonte"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.md5(F.col("id").cast("string"))).alias("content_hash"),
    )
    best = draw.one_per_content(rows)
    assert plan_of(best).count("HashAggregate") == 2 and "SortAggregate" not in plan_of(best)
    assert best.count() == 60_001
    assert best.filter("content_hash = 'hot'").first()["id"] == 0


def test_hot_digest_with_distinct_codes(spark):
    """One statement in a third of all rows, every row with its own code."""
    rows = spark.range(0, 30_000, 1, 6).select(
        F.col("id").alias("seq"), F.concat(F.lit("Q"), "id").alias("id_qc"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("h"), "id")).alias("hash_enunciado"),
    )
    assert ingest.insert_if_new(rows).count() == 20_001


def test_hot_pending_key_is_split_at_run_time(spark, monkeypatch):
    """The hot statement's first row is blocked by its code, so in the first round all
    its rows are still pending when they meet the winners."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    split = []
    durable = conflicts.durable

    def observed(df, label="step"):
        if label == "round":
            df.collect()
            split.append(plan_of(df).split("== Initial Plan ==")[0].count("skew=true"))
        return durable(df, label)

    monkeypatch.setattr(conflicts, "durable", observed)
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        hot = (F.col("id") % 3 == 0) & (F.col("id") > 0)
        rows = spark.range(0, 300_000, 1, 6).select(
            F.col("id").alias("seq"),
            F.concat(F.lit("Q"), F.when(F.col("id") == 3, 2).otherwise(F.col("id"))).alias("id_qc"),
            F.when(hot, "hot").otherwise(F.md5(F.col("id").cast("string"))).alias("hash_enunciado"),
        )
        assert ingest.insert_if_new(rows).count() == 200_002
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert split[0] > 0


def test_step_tables_are_dropped_on_request(spark):
    from quaestor import session

    earlier, session._STEPS[:] = list(session._STEPS), []
    step = session.durable(spark.range(3))
    assert step.count() == 3 and session.drop_steps(spark) == 1 and session.drop_steps(spark) == 0
    session._STEPS[:] = earlier
