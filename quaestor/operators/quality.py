"""Data checks as one report: ``check, key, n_bad``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Allowed answer letters.
CHOICE_LETTERS = ["A", "B", "C", "D", "E"]
TRUE_FALSE_LETTERS = ["C", "E"]


def _count_checks(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """All checks in one aggregate, then one row per check that found something."""
    counted = rows.groupBy(F.col(key).alias("key")).agg(
        *[F.count_if(F.coalesce(bad, F.lit(True))).alias(name) for name, bad in checks.items()]
    )
    pairs = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("n_bad")) for n in checks])
    return counted.select("key", F.inline(pairs)).filter("n_bad > 0").select("check", "key", "n_bad")


def option_checks(
    questions: DataFrame, key: str = "fonte", allowed: list[str] = CHOICE_LETTERS
) -> DataFrame:
    """``allowed`` is ``TRUE_FALSE_LETTERS`` for true/false exams."""
    letters = F.map_keys("alternativas")
    count = F.coalesce(F.size("alternativas"), F.lit(0))
    choice = F.size(F.array_except(letters, F.array(*map(F.lit, allowed)))) == 0
    return _count_checks(
        questions, key,
        {"not_five_options": count != 5, "under_two_options": count < 2, "bad_letter": ~choice},
    )


def answer_checks(questions: DataFrame, key: str = "fonte") -> DataFrame:
    missing = F.col("gabarito").isNull()
    among = F.map_contains_key("alternativas", F.coalesce("gabarito", F.lit("")))
    return _count_checks(
        questions, key, {"answer_missing": missing, "answer_not_an_option": ~missing & ~among}
    )


def spec_checks(specs: DataFrame) -> DataFrame:
    exam = _count_checks(
        specs, "concurso",
        {
            "exam_without_board": F.col("banca").isNull(),
            "job_missing": F.col("cargo").isNull(),
            "subject_missing": F.col("materia").isNull(),
            "weight_not_positive": F.coalesce(F.col("peso") <= 0, F.lit(True)),
        },
    )
    twice = (
        specs.groupBy("concurso", "cargo", "materia").agg(F.count("*").alias("n")).filter("n > 1")
        .groupBy(F.col("concurso").alias("key")).agg(F.count("*").alias("n_bad"))
        .select(F.lit("subject_twice").alias("check"), "key", "n_bad")
    )
    return exam.unionByName(twice)


def weight_sum_checks(specs: DataFrame) -> DataFrame:
    """Jobs whose weights do not sum to the declared number of questions."""
    sums = specs.groupBy("concurso", "cargo").agg(
        F.sum("peso").alias("soma"), F.max("total_questoes").alias("declarado")
    )
    return sums.filter("declarado is not null and soma <> declarado").select(
        "concurso", "cargo", "soma", "declarado"
    )


def quota_checks(quotas: DataFrame) -> DataFrame:
    """Exams whose quotas do not sum to the quantity asked for (weights not all zero)."""
    sums = quotas.groupBy("exam").agg(
        F.sum("quota").alias("soma"), F.max("q").alias("q"), F.sum("peso").alias("pesos")
    )
    bad = (F.col("soma") != F.col("q")) & (F.col("pesos") != 0)
    return sums.select("exam", "soma", "q", bad.cast("int").alias("n_bad"))


def duplicate_checks(questions: DataFrame, digest: str = "hash_enunciado") -> DataFrame:
    """Digests held by more than one row."""
    return questions.groupBy(digest).agg(F.count("*").alias("n")).filter("n > 1")


def round_trip_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows in only one of two tables, with ``lado``; empty when they agree."""
    common = [c for c in left.columns if c in right.columns]
    a, b = left.select(common), right.select(common)
    return a.exceptAll(b).withColumn("lado", F.lit("left")).unionByName(
        b.exceptAll(a).withColumn("lado", F.lit("right"))
    )


def report(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select("check", F.col("key").cast("string").alias("key"), "n_bad") for p in parts])
