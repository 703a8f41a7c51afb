"""Exams as compositions of quotas, draws and numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions import text
from quaestor.operators import allocation, draw
from quaestor.session import durable

# Fixed value: text shown where the answer is not known.
MISSING_ANSWER = "(gabarito ainda não coletado)"


def subject_exams(questions: DataFrame, requests: DataFrame, seed: str | None = None) -> DataFrame:
    """One-subject exams: ``requests(exam, materia[, n])``."""
    if "n" not in requests.columns:
        requests = requests.withColumn("n", F.lit(draw.SUBJECT_EXAM_SIZE))
    return draw.draw(questions, requests, seed=seed).withColumn("secao", F.lit(1))


def general_exams(questions: DataFrame, specs: DataFrame, seed: str | None = None) -> DataFrame:
    """General exams: quotas by weight, shortage redistributed, sections by subject name.
    ``specs`` is ``exam, q, materia, ordinal, peso``.

    The content pool serves both the counts and the draw, so it is stored once; so are the
    requests, a row per exam and subject.
    """
    pool = durable(draw.content_pool(questions, "materia"))
    quotas = allocation.largest_remainder(specs)
    raised = allocation.redistribute(quotas, draw.available(pool, "materia"))
    requests = durable(raised.select("exam", "materia", (F.col("taken") + F.col("extra")).alias("n")).filter("n > 0"))
    ranked = draw.rank_pool(pool, seed=seed, asked=draw.most_asked(requests, ("materia",)))
    return draw.serve(ranked, requests, ("materia",)).withColumn("secao", F.col("materia"))


def job_exams(questions: DataFrame, specs: DataFrame, seed: str | None = None) -> DataFrame:
    """Job exams: questions of that agency and job (and board, where the request names
    one), sections in listed order, no redistribution. ``specs`` is ``exam, q, orgao,
    cargo, banca, materia, ordinal, peso``; a NULL board does not filter."""
    quotas = allocation.largest_remainder(specs).withColumnRenamed("quota", "n").filter("n > 0")
    quotas = quotas.withColumn("secao", F.col("ordinal"))
    # every question stands under its board and under any board, so one draw serves both kinds
    any_board, board = F.lit("*"), F.concat(F.lit("="), "banca")
    quotas = quotas.withColumn("_board", F.when(F.coalesce("banca", F.lit("")) != "", board).otherwise(any_board))
    listed = questions.withColumn("_board", F.explode(F.filter(F.array(any_board, board), lambda b: b.isNotNull())))
    return draw.draw(listed, quotas, ("materia", "orgao", "cargo", "_board"), seed, ("secao",)).drop("_board")


def board_exams(questions: DataFrame, structure: DataFrame, seed: str | None = None) -> DataFrame:
    """Board exams: rounded quota per discipline, first occurrence of an id, back-fill
    from any subject, at most q. ``structure`` is ``exam, q, ordem, disciplina, qtd``.
    Gives ``exam, pos, id``.

    What the disciplines yield (at most exams x q rows) is stored, as the back-fill asks
    for it several times.
    """
    quotas = allocation.rounded_quota(structure)
    requests = quotas.select("exam", "ordem", F.col("disciplina").alias("materia"), F.col("quota").alias("n"))
    drawn = draw.draw(questions, requests, ("materia",), seed, ("ordem",))
    chosen = durable(draw.keep_first(drawn, ("exam", "id"), "ordem", "rank"))
    counts = chosen.groupBy("exam").agg(F.count("*").alias("_c"))
    exam_sizes = structure.groupBy("exam").agg(F.max("q").alias("q"))
    missing = exam_sizes.join(counts, "exam", "left").select(
        "exam", (F.col("q") - F.coalesce("_c", F.lit(0))).alias("n")
    )
    # quotas may sum to more than q, but then nothing is missing: n + chosen <= q
    filled = draw.backfill(draw.content_pool(questions), chosen, missing, seed)
    listed = chosen.select("exam", F.lit(0).alias("_part"), F.col("ordem").alias("_list"), "rank", "id").unionByName(
        filled.select("exam", F.lit(1).alias("_part"), F.lit(0).alias("_list"), "rank", "id")
    )
    pos = F.row_number().over(Window.partitionBy("exam").orderBy("_part", "_list", "rank"))
    return (
        listed.withColumn("pos", pos).join(exam_sizes, "exam").filter("pos <= q").select("exam", "pos", "id")
    )


def number_items(items: DataFrame, *order: str) -> DataFrame:
    """Add ``numero``, running over all sections of an exam."""
    return items.withColumn("numero", F.row_number().over(Window.partitionBy("exam").orderBy(*order)))


def exam_sheet(items: DataFrame, questions: DataFrame, *order: str) -> DataFrame:
    """Printable rows. Items are numbered on keys only; the wide question columns are
    joined at the end."""
    numbered = number_items(items.select("exam", "id", *order), *order).select("exam", "numero", *order, "id")
    wide = questions.select(
        "id", "materia", "enunciado", "alternativas", "gabarito", "comentario",
        "banca", "orgao", "ano", "assunto", "texto_associado", "imagens",
    )
    shared = (F.coalesce("texto_associado", F.lit("")) != "") | (F.coalesce(F.size("imagens"), F.lit(0)) > 0)
    joined = numbered.drop("materia").join(wide, "id")
    return joined.select(
        "exam",
        "numero",
        F.upper("materia").alias("secao_titulo"),
        "id",
        "enunciado",
        text.options_in_order("alternativas").alias("opcoes"),
        text.provenance("banca", "orgao", "ano", "assunto").alias("origem"),
        F.when(shared, F.concat(F.lit("Texto para a questão "), F.col("numero").cast("string"), F.lit("."))).alias("chamada_texto"),
        "gabarito",
        "comentario",
    )


def answer_key(sheet: DataFrame) -> DataFrame:
    known = F.coalesce("gabarito", F.lit("")) != ""
    return sheet.select(
        "exam",
        "numero",
        F.when(known, F.col("gabarito")).otherwise(MISSING_ANSWER).alias("resposta"),
        F.when(known, F.coalesce("comentario", F.lit(""))).otherwise("").alias("comentario"),
    )


def exam_summary(requests: DataFrame, items: DataFrame) -> DataFrame:
    """Every requested exam with its size and suggested minutes; an exam that found no
    question is reported with 0."""
    sizes = items.groupBy("exam").agg(F.count("*").alias("questoes"))
    rows = requests.select("exam").distinct().join(sizes, "exam", "left").withColumn(
        "questoes", F.coalesce("questoes", F.lit(0))
    )
    return rows.withColumn("minutos", text.suggested_minutes("questoes"))


def exams_by_topic(questions: DataFrame, requests: DataFrame, seed: str | None = None) -> DataFrame:
    """Exams by category or, where the request has a topic column, by topic."""
    keys = ("categoria", "tema") if "tema" in requests.columns else ("categoria",)
    return draw.draw(questions, requests, keys, seed)
