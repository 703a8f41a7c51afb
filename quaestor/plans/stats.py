"""Reports. Wide scans are reduced once to small grouped counts; roll-ups, shares and
rankings work on those."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions import text
from quaestor.session import durable


def by_subject(questions: DataFrame) -> DataFrame:
    return questions.groupBy("materia").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("usada") == 0).alias("ineditas"),
        F.sum("usada").cast("bigint").alias("usadas"),
        F.count_if(F.col("gabarito").isNull()).alias("sem_gabarito"),
    )


def of_source(questions: DataFrame, fonte: str = "pci") -> DataFrame:
    return questions.filter(F.col("fonte") == fonte)


def source_status(questions: DataFrame, fonte: str = "pci") -> DataFrame:
    return of_source(questions, fonte).agg(
        F.count("*").alias("total"),
        F.count("categoria").alias("com_categoria"),
        F.countDistinct("categoria").alias("categorias_unicas"),
    )


def count_by(rows: DataFrame, *keys: str, name: str = "total") -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias(name))


def top(counts: DataFrame, k: int, n: str = "total", tie: str = "categoria") -> DataFrame:
    """The k largest, ties by name (NULL first)."""
    return counts.orderBy(F.desc(n), F.asc_nulls_first(tie)).limit(k)


def top_categories(questions: DataFrame, fonte: str = "pci", k: int = 10) -> DataFrame:
    return top(count_by(of_source(questions, fonte), "categoria"), k)


def top_lists(questions: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """The k most frequent values of several columns as ``coluna, nome, total``, from one
    scan: grouping sets over the distinct combinations, then the first k per column."""
    columns = list(sizes)
    cells = questions.groupBy(*columns).agg(F.count("*").alias("n"))
    sets = cells.groupingSets([[c] for c in columns], *columns).agg(
        F.sum("n").alias("total"), *[F.grouping(c).alias(f"_g_{c}") for c in columns]
    )
    which, value, k = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("int")
    for c in columns:
        mine = F.col(f"_g_{c}") == 0
        which = F.when(mine, F.lit(c)).otherwise(which)
        value = F.when(mine, F.col(c).cast("string")).otherwise(value)
        k = F.when(mine, F.lit(sizes[c])).otherwise(k)
    named = sets.select(which.alias("coluna"), value.alias("nome"), "total", k.alias("_k"))
    order = Window.partitionBy("coluna").orderBy(F.desc("total"), F.asc_nulls_first("nome"))
    return (
        named.withColumn("_rn", F.row_number().over(order))
        .filter(F.col("_rn") <= max(sizes.values()))
        .filter("_rn <= _k")
        .drop("_rn", "_k")
    )


def overall(questions: DataFrame) -> DataFrame:
    """``nivel`` (total, orgao, materia), ``chave``, ``total`` from one scan."""
    cells = questions.groupBy("orgao", "materia").agg(F.count("*").alias("n"))
    sets = cells.groupingSets([["orgao"], ["materia"], []], "orgao", "materia").agg(
        F.sum("n").alias("total"),
        F.grouping("orgao").alias("go"),
        F.grouping("materia").alias("gm"),
    )
    level = F.when(F.col("go") == 0, "orgao").when(F.col("gm") == 0, "materia").otherwise("total")
    key = F.when(F.col("go") == 0, F.col("orgao")).when(F.col("gm") == 0, F.col("materia"))
    return sets.select(level.alias("nivel"), key.alias("chave"), "total")


def distinct_totals(questions: DataFrame) -> DataFrame:
    """Total and distinct subjects, sources, categories. The three distinct counts run
    on the distinct combinations, which the first aggregate folds before its shuffle."""
    cells = questions.groupBy("materia", "fonte", "categoria").agg(F.count("*").alias("n"))
    return cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.countDistinct("materia").alias("materias_unicas"),
        F.countDistinct("fonte").alias("fontes_unicas"),
        F.countDistinct("categoria").alias("categorias_unicas"),
    )


def subject_profile(questions: DataFrame, first_categories: int = 3) -> DataFrame:
    """Per subject: count, its sources and its first categories by name.

    Only the first few categories of a subject are ever brought together, so a subject
    with very many categories does not build a large list. The grouped cells are stored,
    as both halves of the report read them.
    """
    cells = durable(
        questions.filter("materia is not null").groupBy("materia", "fonte", "categoria").agg(F.count("*").alias("n"))
    )
    base = cells.groupBy("materia", "fonte").agg(F.sum("n").alias("n")).groupBy("materia").agg(
        F.sum("n").alias("total"),
        F.array_join(F.array_sort(F.collect_set("fonte")), ", ").alias("fontes"),
    )
    names = cells.filter("categoria is not null").select("materia", "categoria").distinct()
    position = F.row_number().over(Window.partitionBy("materia").orderBy("categoria"))
    first = (
        names.withColumn("_rn", position).filter(F.col("_rn") <= first_categories)
        .groupBy("materia")
        .agg(F.array_join(F.array_sort(F.collect_list("categoria")), ", ").alias("categorias"))
    )
    return base.join(first, "materia", "left")


def topic_cells(questions: DataFrame, fonte: str = "pci") -> DataFrame:
    has_images = F.coalesce(F.size("imagens_urls"), F.lit(0)) > 0
    return of_source(questions, fonte).groupBy("categoria", "tema").agg(
        F.count("*").alias("n"), F.count_if(has_images).alias("imgs")
    )


def source_tree(questions: DataFrame, fonte: str = "pci") -> DataFrame:
    """``nivel`` 0 source, 1 category, 2 topic. Rows without category count in the total
    only; rows without topic in their category only."""
    return tree_of(topic_cells(questions, fonte))


def tree_of(cells: DataFrame) -> DataFrame:
    """The tree of counted topics (``categoria, tema, n, imgs``)."""
    tree = cells.rollup("categoria", "tema").agg(
        F.sum("n").alias("total"),
        F.sum("imgs").alias("com_imagens"),
        F.grouping("categoria").alias("gc"),
        F.grouping("tema").alias("gt"),
    )
    level = (2 - F.col("gc") - F.col("gt")).cast("int")
    kept = ((F.col("gc") == 1) | F.col("categoria").isNotNull()) & ((F.col("gt") == 1) | F.col("tema").isNotNull())
    return tree.filter(kept).select(level.alias("nivel"), "categoria", "tema", "total", "com_imagens")


def category_report(questions: DataFrame, categoria: str | None = None, fonte: str = "pci") -> DataFrame:
    """Topic rows with image share, all categories unless one is named."""
    rows = questions if categoria is None else questions.filter(F.col("categoria") == categoria)
    tree = source_tree(rows, fonte).filter("nivel >= 1")
    return tree.withColumn("percentual_imagens", text.percent("com_imagens", "total"))


def live_monitor(questions: DataFrame, fonte: str = "pci") -> DataFrame:
    counts = of_source(questions, fonte).agg(
        F.count("*").alias("total"), F.count("categoria").alias("com_categoria"), F.count("tema").alias("com_tema")
    )
    floor_one = F.greatest(F.lit(1), F.col("total"))
    return counts.withColumns(
        {
            "pct_categoria": F.bround(100.0 * F.col("com_categoria") / floor_one, 1),
            "pct_tema": F.bround(100.0 * F.col("com_tema") / floor_one, 1),
        }
    )


def sample_question(questions: DataFrame, fonte: str = "pci") -> DataFrame:
    """The classified question with the smallest id."""
    rows = of_source(questions, fonte).filter("categoria is not null")
    return rows.select("id", "materia", "categoria", "tema", "enunciado").orderBy("id").limit(1)


def dashboard_counters(questions: DataFrame, fonte: str = "pci") -> DataFrame:
    """Categories, topics inside categories, and their rows with images."""
    cells = topic_cells(questions, fonte).filter("categoria is not null")
    topic = F.when(F.col("tema").isNotNull(), F.struct("categoria", "tema"))
    return cells.agg(
        F.countDistinct("categoria").alias("categorias"),
        F.countDistinct(topic).alias("temas"),
        F.coalesce(F.sum(F.when(F.col("tema").isNotNull(), F.col("imgs"))), F.lit(0)).alias("com_imagens"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
    )


def bank_metrics(questions: DataFrame) -> DataFrame:
    return questions.agg(
        F.count("*").alias("total"),
        F.count("categoria").alias("com_categoria"),
        F.count_if(F.coalesce(F.size("imagens_urls"), F.lit(0)) > 0).alias("com_imagens"),
    )


def distribution(questions: DataFrame) -> DataFrame:
    """Every combination of category, year and board, as a cube over grouped counts.
    ``nivel`` is the grouping id (7 = grand total)."""
    cells = questions.groupBy("categoria", "ano", "banca").agg(F.count("*").alias("n"))
    return cells.cube("categoria", "ano", "banca").agg(
        F.sum("n").alias("total"), F.grouping_id().cast("int").alias("nivel")
    )


def shares(counts: DataFrame, n: str = "total") -> DataFrame:
    """Share of the grand total (one decimal), whole percent, share of the largest, and
    what remains. Halves round up, as the dashboards show them. The overall numbers are
    one scalar subquery, so the counts never meet in one window task."""
    whole = counts.agg(F.struct(F.sum(n).alias("s"), F.max(n).alias("m"))).scalar()
    overall_sum, overall_max = whole["s"], whole["m"]
    divisor = F.when(overall_sum == 0, 1).otherwise(overall_sum)
    return counts.withColumns(
        {
            "pct_total": F.round(100.0 * F.col(n) / divisor, 1),
            "pct_inteiro": F.floor(100.0 * F.col(n) / divisor + 0.5).cast("bigint"),
            "pct_maior": F.round(100.0 * F.col(n) / overall_max, 1),
            "restante": F.greatest(F.lit(0), overall_sum - F.col(n)),
        }
    )


def study_streaks(study_days: DataFrame, today: str | None = None) -> DataFrame:
    """Longest and current run of consecutive days per user (gaps and islands).
    ``study_days`` is ``user_id, dia``; current = the run that reaches the last day of
    the table (or ``today``)."""
    days = study_days.select("user_id", "dia").distinct()
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("dia"))
    runs = (
        days.withColumn("_grupo", F.date_sub("dia", order))
        .groupBy("user_id", "_grupo")
        .agg(F.count("*").alias("dias"), F.max("dia").alias("ate"))
    )
    last = F.lit(today).cast("date") if today else study_days.agg(F.max("dia")).scalar()
    return runs.groupBy("user_id").agg(
        F.max("dias").alias("maior"),
        F.coalesce(F.max(F.when(F.col("ate") == last, F.col("dias"))), F.lit(0)).alias("atual"),
    )


def rewards(questions: DataFrame, fonte: str = "pci") -> DataFrame:
    """Experience points and badges for the bank total, one row per badge."""
    total = of_source(questions, fonte).agg(F.count("*").alias("total"))
    return total.select(
        "total", text.experience_points("total").alias("xp"), F.inline(text.badges("total"))
    )


def top_progress(progress: DataFrame, k: int = 3) -> DataFrame:
    return progress.orderBy(F.desc("ultima_pagina"), "fonte", "chave").limit(k)
