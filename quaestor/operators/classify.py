"""Lookups of subjects and categories, coverage joins and crawl worklists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.functions import text
from quaestor.operators.ingest import latest_progress

# Score of the first category when no keyword is found; page caps.
FALLBACK_SCORE = 0.3
PAGE_CAP = 200
SESSION_PAGES = 40


def subject_of_topic(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``materia_edital``: rule for the exact topic, else for the whole category,
    else NULL. A category-wide rule has a NULL topic."""
    exact = rules.filter("tema is not null").select(
        "categoria", "tema", F.col("materia").alias("_exata")
    )
    wide = rules.filter("tema is null").select("categoria", F.col("materia").alias("_geral"))
    return (
        rows.join(exact, ["categoria", "tema"], "left")
        .join(wide, "categoria", "left")
        .withColumn("materia_edital", F.coalesce("_exata", "_geral"))
        .drop("_exata", "_geral")
    )


def unmapped_topics(rows: DataFrame, rules: DataFrame) -> DataFrame:
    topics = rows.filter("categoria is not null and tema is not null").groupBy("categoria", "tema").agg(
        F.count("*").alias("n")
    )
    return subject_of_topic(topics, rules).filter("materia_edital is null").drop("materia_edital")


def rules_without_category(rules: DataFrame, known: DataFrame) -> DataFrame:
    return rules.join(known.select("categoria").distinct(), "categoria", "left_anti")


def _pieces(c, size):
    """All substrings of one length."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(c) - (size - 1), F.lit(1)))
    return F.when(
        F.length(c) >= size, F.transform(starts, lambda i: F.substring(c, i, F.lit(size)))
    ).otherwise(F.array().cast("array<string>"))


def _grams(c, sizes):
    return F.array_distinct(F.concat(*[_pieces(c, n) for n in sizes]))


def subject_of_title(titles: DataFrame, aliases: DataFrame, title: str = "titulo") -> DataFrame:
    """Add ``materia``: the first subject one of whose aliases is contained in the
    title (blanks collapsed, upper case), NULL when there is none.

    Containment becomes an equi-join: an alias can only be contained where its first
    three characters occur, so titles are matched on their three-character pieces (one-
    and two-character aliases on those) and then verified. Each distinct title is looked
    up once.
    """
    shown = F.upper(F.trim(F.regexp_replace(F.col(title), r"(?U)\s+", " ")))
    distinct = titles.select(title).distinct().withColumn("_t", shown)
    keyed = aliases.withColumn("_g", F.left("alias", F.lit(3)))
    pieces = distinct.select(title, "_t", F.explode(_grams(F.col("_t"), (1, 2, 3))).alias("_g"))
    hits = (
        pieces.join(keyed, "_g")
        .filter(F.contains("_t", "alias"))
        .groupBy(title)
        .agg(F.min(F.struct("mat_pos", "materia")).alias("m"))
        .select(title, F.col("m.materia").alias("materia"))
    )
    return titles.join(hits, title, "left")


def suggest_category(
    rows: DataFrame, keywords: DataFrame, statement: str = "enunciado", snippet_chars: int | None = None,
    taxonomy: DataFrame | None = None,
) -> DataFrame:
    """Add ``categoria_sugerida`` and ``confianca``.

    The score of a category is the share of its keywords contained in the lower-cased
    text; the best one wins, ties go to the category listed first. Without a hit the
    subject's first category in ``taxonomy`` (``materia, categoria, cat_pos``) is taken at
    ``FALLBACK_SCORE``; a subject that the taxonomy does not know gives NULL and 0, whatever
    its keywords. Without a taxonomy the keyword table is taken for it. ``keywords`` is ``materia, categoria, cat_pos, kws``; it is packed
    into one array per subject, so the join does not multiply rows.
    """
    packed = keywords.groupBy("materia").agg(
        F.array_sort(F.collect_list(F.struct("cat_pos", "categoria", "kws"))).alias("_cats")
    )
    source = F.left(F.col(statement), F.lit(snippet_chars)) if snippet_chars else F.col(statement)
    listed = (keywords if taxonomy is None else taxonomy).groupBy("materia").agg(F.min_by("categoria", "cat_pos").alias("_first"))
    # one row per subject, from tables written by hand: sent to the rows, which else meet by subject, a few tasks for all texts
    joined = rows.join(F.broadcast(packed), "materia", "left").join(F.broadcast(listed), "materia", "left").withColumn("_low", F.lower(source))
    scores = F.transform(
        F.col("_cats"),
        lambda c: F.struct(
            (
                F.size(F.filter(c["kws"], lambda k: F.contains(F.col("_low"), k)))
                / F.greatest(F.size(c["kws"]), F.lit(1))
            ).alias("score"),
            (-c["cat_pos"]).alias("pos"),
            c["categoria"].alias("cat"),
        ),
    )
    best = joined.withColumn("_best", F.array_max(scores))
    hit = (F.col("_best.score") > 0) & F.col("_first").isNotNull()
    return best.withColumns(
        {
            "categoria_sugerida": F.when(hit, F.col("_best.cat")).otherwise(F.col("_first")),
            "confianca": F.when(hit, F.col("_best.score")).when(F.col("_first").isNotNull(), FALLBACK_SCORE).otherwise(0.0),
        }
    ).drop("_cats", "_low", "_best", "_first")


def categories_of(taxonomy: DataFrame, materia: str | None = None) -> DataFrame:
    """Categories per subject in listed order."""
    rows = taxonomy if materia is None else taxonomy.filter(F.col("materia") == materia)
    return rows.groupBy("materia", "categoria").agg(F.min("cat_pos").alias("cat_pos")).orderBy("materia", "cat_pos")


def topics_of(taxonomy: DataFrame, materia: str | None = None, categoria: str | None = None) -> DataFrame:
    rows = taxonomy
    if materia is not None:
        rows = rows.filter(F.col("materia") == materia)
    if categoria is not None:
        rows = rows.filter(F.col("categoria") == categoria)
    return rows.select("materia", "categoria", "tema", "cat_pos", "tema_pos").orderBy("materia", "cat_pos", "tema_pos")


# --- specification lookups -------------------------------------------------

def list_exams(specs: DataFrame) -> DataFrame:
    return specs.select("concurso").distinct().orderBy("concurso")


def list_jobs(specs: DataFrame, concurso: str | None = None) -> DataFrame:
    rows = specs if concurso is None else specs.filter(F.col("concurso") == concurso)
    return rows.select("concurso", "cargo").distinct().orderBy("concurso", "cargo")


def subjects_of(specs: DataFrame, concurso: str | None = None, cargo: str | None = None) -> DataFrame:
    """Subjects with weight in listed order; the topic list of a subject is empty by
    definition."""
    rows = specs
    if concurso is not None:
        rows = rows.filter(F.col("concurso") == concurso)
    if cargo is not None:
        rows = rows.filter(F.col("cargo") == cargo)
    return rows.select(
        "concurso", "cargo", "ordinal", "materia", "peso", F.array().cast("array<string>").alias("assuntos")
    )


def weights_by_job(specs: DataFrame) -> DataFrame:
    """One row per job: weights as a map and their total. A job lists a handful of
    subjects, so the collected group is bounded by the specification."""
    return specs.groupBy("concurso", "cargo").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("materia", "peso")))).alias("pesos"),
        F.sum("peso").alias("total"),
    )


def coverage(specs: DataFrame, questions: DataFrame, by_orgao: bool = False) -> DataFrame:
    """Collected questions per job and subject against the expected weight, plus one
    total row per job (``materia`` NULL, ``nivel_total`` 1)."""
    keys = ["materia", "cargo"] + (["orgao"] if by_orgao else [])
    counts = questions.groupBy(*keys).agg(F.count("*").alias("coletadas"))
    per_subject = specs.join(counts, keys, "left").select(
        "concurso", "cargo", "materia", F.col("peso").alias("esperadas"),
        F.coalesce("coletadas", F.lit(0)).alias("coletadas"),
    )
    rows = per_subject.groupingSets(
        [["concurso", "cargo", "materia"], ["concurso", "cargo"]], "concurso", "cargo", "materia"
    ).agg(
        F.sum("coletadas").alias("coletadas"),
        F.sum("esperadas").alias("esperadas"),
        F.grouping("materia").cast("int").alias("nivel_total"),
    )
    return rows.withColumn("percentual", text.percent("coletadas", "esperadas"))


def category_info(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Collected against expected per category; unknown ones show no name and 0."""
    return (
        counts.join(totals, "categoria", "left")
        .withColumn("esperado", F.coalesce("esperado", F.lit(0)))
    )


def enrich_from_spec(rows: DataFrame, specs: DataFrame) -> DataFrame:
    """Board, agency and first job of the exam, and topic = subject, onto rows that know
    their exam and subject."""
    order = F.struct("ordem_cargo", "ordinal")
    per_exam = specs.groupBy("concurso").agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in ("banca", "orgao")],
        F.min_by("cargo", order).alias("cargo"),
    )
    return (
        rows.join(per_exam, "concurso", "left")
        .withColumns(
            {
                "banca": F.coalesce("banca", F.lit("QConcursos")),
                "orgao": F.coalesce("orgao", "concurso"),
                "assunto": F.col("materia"),
            }
        )
    )


# --- worklists --------------------------------------------------------------

def pages_to_fetch(topics: DataFrame, progress_log: DataFrame, cap: int | None = None, per_session: int | None = None) -> DataFrame:
    """``fonte, chave, pagina, url`` for every page after the stored one, up to ``cap``
    or ``per_session`` pages further; with neither, the next page. ``topics`` is ``fonte, chave, base``."""
    nxt = F.coalesce("ultima_pagina", F.lit(0)) + 1
    last = F.lit(cap) if cap is not None and not per_session else nxt + ((per_session or 1) - 1)
    return (
        topics.join(latest_progress(progress_log), ["fonte", "chave"], "left")
        .withColumns({"_de": nxt, "_ate": last})
        .filter("_de <= _ate")
        .select("fonte", "chave", "base", F.explode(F.sequence("_de", "_ate")).alias("pagina"))
        .withColumn("url", text.page_url("base", "pagina"))
        .drop("base")
    )


def pages_to_revisit(topics: DataFrame, progress_log: DataFrame) -> DataFrame:
    """Pages 1 to the last stored one for keys that have progress and a URL."""
    return (
        topics.filter(F.coalesce("base", F.lit("")) != "")
        .join(latest_progress(progress_log), ["fonte", "chave"])
        .filter("ultima_pagina >= 1")
        .select("fonte", "chave", "base", F.explode(F.sequence(F.lit(1), F.col("ultima_pagina"))).alias("pagina"))
        .withColumn("url", text.search_page_url("base", "pagina"))
        .drop("base")
    )


def pending_answers(questions: DataFrame) -> DataFrame:
    return questions.filter("gabarito is null and id_qc is not null")


def pending_numbers(questions: DataFrame) -> DataFrame:
    """Distinct pending question numbers per subject, one per row: a subject may have
    any number of them."""
    return pending_answers(questions).select("materia", F.expr("substr(id_qc, 2)").alias("numero")).distinct()


def pending_counts(questions: DataFrame) -> DataFrame:
    return pending_numbers(questions).groupBy("materia").agg(F.count("*").alias("pendentes"))


def answerable_now(questions: DataFrame, on_page: DataFrame) -> DataFrame:
    """Pending numbers that the fetched pages offer. ``on_page`` has ``numero``."""
    return pending_numbers(questions).join(on_page.select("numero"), "numero", "left_semi")
