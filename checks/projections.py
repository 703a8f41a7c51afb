"""Test tables as question-bank tables. Every projection reads whole driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.functions import text
from quaestor.schemas import QUESTIONS
from quaestor.session import work_path
from quaestor.sources.questions import add_missing_columns, append_questions, read_questions

LETTERS = "ABCDE"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The test tables have one row group each: one task per core for what follows, and four for each part
    that a table is read in, so that the rows of a task, which it sorts to store them, don't grow with the table."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, 4 * df.rdd.getNumPartitions())
    return df.repartition(tasks, *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _piece(k: int) -> str:
    return f"substr(text, 1 + {k} * ((length(text) + 4) div 5), (length(text) + 4) div 5)"


OPTIONS = (
    "map_from_entries(filter(array("
    + ", ".join(
        f"named_struct('key', {repr(c) if c != 'E' else 'CASE WHEN doc_id % 17 = 0 THEN ' + repr('F') + ' ELSE ' + repr('E') + ' END'}, 'value', {_piece(k)})"
        for k, c in enumerate(LETTERS)
    )
    + "), e -> NOT (doc_id % 9 = 0 AND e.key IN ('E', 'F'))))"
)


# columns of a question as it arrives, from a document and its labels
ARRIVING = {
    "id": "doc_id",
    "id_qc": """CASE WHEN doc_id % 7 = 0 THEN NULL
                WHEN doc_id % 10 = 9 THEN concat('Q', doc_id - 1)
                ELSE concat('Q', doc_id) END""",
    "enunciado": "text",
    "alternativas": OPTIONS,
    "gabarito": "CASE quality WHEN 1 THEN 'C' WHEN 0 THEN 'E' END",
    "comentario": "CASE WHEN doc_id % 3 = 0 THEN concat('c', doc_id) END",
    "materia": "lang",
    "assunto": "CASE WHEN doc_id % 6 = 0 THEN '' ELSE source END",
    "ano": "CAST(2015 + doc_id % 12 AS INT)",
    "prova": "CAST(NULL AS STRING)",
    "fonte": """CASE CAST(substr(source, 4) AS INT) % 3 WHEN 0 THEN 'qconcursos'
                WHEN 1 THEN 'pci' ELSE 'quadrix_pdf' END""",
    "usada": "CAST(coalesce(toxic, 0) AS INT)",
    "texto_associado": "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN lang END",
    "imagens": "CASE WHEN doc_id % 5 = 0 THEN array(concat('i', doc_id)) END",
    "categoria": "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE source END",
    "tema": "CASE WHEN doc_id % 13 = 0 THEN NULL ELSE concat('t', doc_id % 5) END",
    "imagens_urls": """CASE doc_id % 3 WHEN 0 THEN CAST(array() AS ARRAY<STRING>)
                WHEN 1 THEN array(concat('u', doc_id))
                ELSE array(concat('u', doc_id), concat('u', doc_id)) END""",
    "banca": "concat('banca', doc_id % 4)",
    "orgao": "concat('orgao', doc_id % 3)",
    "cargo": "concat('cargo', doc_id % 2)",
    "seq": "doc_id",
}
# those that pages show
SHOWN = ("id", "id_qc", "enunciado", "alternativas", "materia", "assunto", "ano", "texto_associado", "banca", "orgao")


def raw_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions as they arrive, hashes computed on the fly."""
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "l_id")
    rows = docs.join(labels, docs.doc_id == labels.l_id, "left").selectExpr(*[f"{e} AS {name}" for name, e in ARRIVING.items()])
    return rows.withColumns(
        {
            "hash_enunciado": text.statement_hash("enunciado"),
            "content_hash": text.content_hash("enunciado", "alternativas"),
        }
    )


def arriving_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and statements of the questions as they arrive."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "text AS enunciado")


_STORED: dict[tuple[str, str, str], str] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = work_path(spark, name)
        make(spark, sf_dir).write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def stored_path(spark: SparkSession, sf_dir: str) -> str:
    """The question table as the library stores it, written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, "questions")
    if key not in _STORED:
        path = work_path(spark, "questions")
        rows = add_missing_columns(raw_questions(spark, sf_dir), QUESTIONS)
        append_questions(rows.select(QUESTIONS.fieldNames()), path)
        _STORED[key] = path
    return _STORED[key]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored question table, in ingest order by ``seq``."""
    return read_questions(spark, stored_path(spark, sf_dir)).withColumn("seq", F.col("id"))


def unique_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bank without repeated content: the smallest id of each statement."""
    rows = questions(spark, sf_dir)
    first = rows.groupBy("hash_enunciado").agg(F.min("id").alias("id")).select("id")
    return rows.join(first, "id", "left_semi")


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored specification table, written once per session."""
    return _stored(spark, sf_dir, "specs", raw_specs)


def raw_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs per nation, subjects from customer keys, weights = customers."""
    rows = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey")
    )
    counted = rows.groupBy(
        "n_name", "n_nationkey",
        F.expr("concat('cargo', (c_custkey div 5) % 2)").alias("cargo"),
        F.expr("CAST(c_custkey % 5 AS INT) + 1").alias("ordinal"),
    ).agg(F.count("*").alias("peso"))
    totals = counted.groupBy("n_name", "cargo").agg(F.sum("peso").alias("_s"))
    return counted.join(totals, ["n_name", "cargo"]).selectExpr(
        "n_name AS concurso",
        "concat('Concurso ', n_name) AS nome",
        "CASE WHEN n_nationkey % 6 <> 5 THEN concat('banca', n_nationkey % 4) END AS banca",
        "CAST(2020 + n_nationkey % 5 AS INT) AS ano",
        "concat('orgao', n_nationkey % 3) AS orgao",
        "'Multipla_Escolha' AS formato",
        "CAST(_s + n_nationkey % 3 AS INT) AS total_questoes",
        "120 AS tempo_minutos",
        "cargo",
        "'superior' AS nivel",
        "CAST(100 + n_nationkey AS INT) AS vagas",
        "ordinal",
        "element_at(array('en', 'fr', 'de', 'es', 'it'), ordinal) AS materia",
        "peso",
        "concat(n_name, '/', cargo) AS exam",
        "CAST(20 + 10 * (n_nationkey % 5) AS INT) AS q",
        "n_nationkey * 2 + CAST(right(cargo, 1) AS INT) AS exam_pos",
        "CAST(right(cargo, 1) AS INT) AS ordem_cargo",
    )


def spec_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same specifications as text documents, one per exam, headers from the first job."""
    jobs = specs(spark, sf_dir).withColumn("arquivo", F.col("concurso")).groupBy(
        "arquivo", "nome", "ano", "orgao", "formato", "tempo_minutos", "banca", "cargo", "nivel", "vagas"
    ).agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "materia", "peso"))).alias("m"),
        F.max("total_questoes").alias("t"),
    )
    body = F.expr(
        """concat('    "', cargo, '":\n      nivel: "', nivel, '"\n      vagas: ', vagas, '\n      materias:\n',
           array_join(transform(m, x -> concat('        "', x.materia, '": ', x.peso)), '\n'))"""
    )
    return jobs.withColumn("corpo", body).groupBy(
        "arquivo", "nome", "ano", "orgao", "formato", "tempo_minutos", "banca"
    ).agg(
        F.array_sort(F.collect_list(F.struct("cargo", "corpo"))).alias("j"), F.max("t").alias("t")
    ).selectExpr(
        "arquivo",
        """concat('# exam file\n', arquivo, ':\n  nome: "', nome, '"\n',
             coalesce(concat('  banca: "', banca, '"\n'), ''), '  ano: ', ano, '\n  orgao: "', orgao,
             '"\n  formato: "', formato, '"\n  total_questoes: ', t, '\n  tempo_minutos: ', tempo_minutos,
             '   # minutes\n\n  cargos:\n', array_join(transform(j, x -> x.corpo), '\n\n'), '\n') AS texto""",
    )


def board_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Board structure documents: one per region, nations as disciplines; odd regions use
    another top key than the file name."""
    rows = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey")
    ).join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    per = rows.groupBy("r_regionkey", "r_name", "n_nationkey", "n_name").agg(F.count("*").alias("qtd"))
    return per.groupBy("r_regionkey", "r_name").agg(
        F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name", "qtd"))).alias("d")
    ).selectExpr(
        "r_name AS arquivo",
        """concat(CASE WHEN r_regionkey % 2 = 1 THEN concat('instituto_', r_name) ELSE r_name END,
             ':\n  nome_oficial: "', r_name, '"\n  estilo_visual:\n    layout_colunas: 2\n    cores_dominantes: ["Preto"]\n',
             '  estrutura_disciplinas_padrao:\n',
             array_join(transform(d, x -> concat('    - ordem: ', x.n_nationkey, '\n      nome: "', x.n_name,
               ' (base)"\n      quantidade_questoes: ', x.qtd)), '\n'), '\n') AS texto""",
    )


def taxonomy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand -> type -> size of part as a taxonomy document per brand."""
    p = table(spark, sf_dir, "part")
    types = p.groupBy("p_brand", "p_type", "p_size").agg(F.count("*")).groupBy("p_brand", "p_type").agg(
        F.array_sort(F.collect_list("p_size")).alias("s")
    )
    return types.groupBy("p_brand").agg(
        F.array_sort(F.collect_list(F.struct("p_type", "s"))).alias("t")
    ).selectExpr(
        "p_brand AS arquivo",
        """concat('# taxonomy\n\n', p_brand, ':\n', array_join(transform(t, x -> concat('  ', x.p_type, ':\n',
             array_join(transform(x.s, y -> concat('    - tema-', y)), '\n'))), '\n'), '\n') AS texto""",
    )


def progress_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_type AS fonte", "CAST(user_id AS STRING) AS chave", "CAST(floor(value) AS INT) AS pagina", "event_id AS seq"
    )


def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "CASE WHEN event_type = 'signup' AND event_id % 500 = 0 THEN NULL ELSE user_id END AS question_id",
        "event_id % 20 AS exam_id",
        "event_id AS seq",
    )


def study_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("user_id", "CAST(ts AS DATE) AS dia")


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "explode(array('view', 'click', 'error', 'purchase', 'signup')) AS fonte", "*",
    ).selectExpr(
        "fonte",
        "CAST(s_suppkey AS STRING) AS chave",
        "concat('http://example.org/', s_name, CASE WHEN s_suppkey % 2 = 0 THEN '?q=1' ELSE '' END) AS base",
    )


def answer_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "concat('Q', doc_id % 100) AS id_qc",
        "substr('ABCDE', CAST(1 + doc_id % 5 AS INT), 1) AS gabarito",
        "CASE WHEN doc_id % 2 = 1 THEN lang END AS comentario",
        "doc_id AS seq",
    )


def text_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two offers per document; the earlier one is often empty."""
    docs = table(spark, sf_dir, "documents")
    first = docs.selectExpr(
        "concat('Q', doc_id) AS id_qc",
        "CASE WHEN doc_id % 8 = 2 THEN '' ELSE concat('t1 ', lang) END AS texto_associado",
        "CASE WHEN doc_id % 3 = 0 THEN array(concat('n', doc_id)) END AS imagens",
        "doc_id * 2 AS seq",
    )
    second = docs.selectExpr(
        "concat('Q', doc_id)", "concat('t2 ', source)", "CAST(NULL AS ARRAY<STRING>)", "doc_id * 2 + 1"
    )
    return first.union(second)


def legacy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_questions(spark, sf_dir).selectExpr(
        "id", "seq", "id_qc", "enunciado",
        "CASE WHEN id % 17 = 0 THEN '{bad' ELSE to_json(alternativas) END AS alternativas",
        "gabarito", "materia", "assunto", "banca", "orgao", "ano", "prova",
        "CASE WHEN id % 23 = 0 THEN 'outra' ELSE fonte END AS fonte",
        "CASE WHEN id % 19 = 0 THEN '[oops' ELSE to_json(imagens) END AS imagens",
    )


def _escaped(c: str):
    return F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with HTML-escaped statement and pieces, ten to a page. A page's documents meet in a task before they
    become HTML, which repeats the text; a page shows nothing that comes from labels."""
    docs = spread(table(spark, sf_dir, "documents").withColumn("page_id", F.expr("doc_id div 10")), "page_id")
    rows = docs.selectExpr("page_id", *[f"{ARRIVING[name]} AS {name}" for name in SHOWN])
    letters = F.array_sort(F.map_keys("alternativas"))
    return rows.withColumns(
        {"esc": _escaped("enunciado"), "letras": letters}
    ).withColumn(
        "pares",
        F.transform(
            "letras",
            lambda c: F.struct(
                c.alias("l"),
                F.replace(F.replace(F.replace(F.col("alternativas")[c], F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")).alias("t"),
            ),
        ),
    )


def _pages(blocks: DataFrame) -> DataFrame:
    """Ten blocks make a page, so the collected group is bounded."""
    return blocks.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("id", "html"))).alias("b")).selectExpr(
        "page_id",
        "concat('<!DOCTYPE html><html><head><title>p</title><script>var a = \"<p>\";</script></head><body>', "
        "array_join(transform(b, x -> x.html), '\n'), '</body></html>') AS html",
    )


def site_a_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks without code for every seventh, without options for every thirteenth row."""
    return _pages(_blocks(spark, sf_dir).selectExpr(
        "page_id", "id",
        """concat('<div class="card sim-questao" data-sid="', coalesce(id_qc, ''), '">',
             '<div class="sim-texto-base"><b>Base</b> ', materia, '<img src="/b/', id, '.png"></div>',
             '<a class="sim-prova-link" href="#"> ', orgao, ' • ', banca, ' • ', ano, ' </a>',
             '<p class="sim-enunciado">', esc, '</p>',
             CASE WHEN id % 13 = 0 THEN '' ELSE array_join(transform(pares, x -> concat('<button class="btn btn-sim-alt" data-letra="',
               x.l, '">', x.l, ' ', x.t, '</button>')), '') END,
             '<span style="color:red; background-image: url(''http://cdn/', materia, '.png'')"></span></div>') AS html""",
    ))


def site_b_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters given for even rows, by position for odd ones."""
    return _pages(_blocks(spark, sf_dir).selectExpr(
        "page_id", "id",
        """concat('<div class="q-question-item"><span class="q-id"> ', coalesce(id_qc, 'sem código'), ' </span>',
             '<div class="q-question-breadcrumb"><a>', materia, '</a> <a>', assunto, ' , </a></div>',
             '<div class="q-question-info"><span>Ano: ', ano, '</span> <span>Banca: ', banca, '</span> ',
             '<span>Órgão: ', orgao, '</span> <span>Provas: ', orgao, ' - ', ano, ' | </span></div>',
             '<div id="q', id, '-text" class="collapse">', coalesce(texto_associado, ''), '<img src="i', id, '.png"></div>',
             '<div class="q-question-enunciation">', esc, '</div>',
             array_join(transform(pares, (x, i) -> concat('<label class="q-radio-button">',
               CASE WHEN id % 2 = 0 THEN concat('<span class="q-option-item">', x.l, '</span>') ELSE '' END,
               '<div class="q-item-enum">[', x.t, ']</div></label>')), ''), '</div>') AS html""",
    ))


def numbered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain pages: numbered statement, lettered lines, answer line."""
    return _lowered(spark, sf_dir).selectExpr(
        "doc_id AS page_id",
        """concat('cabecalho <b>x</b>\n1. <i>', low, '</i>\nA) op ', substr(low, 1, w), '\nB) op ', substr(low, 1 + w, w),
             '\nC) op ', substr(low, 1 + 2 * w, w), CASE WHEN doc_id % 3 = 0 THEN '\nGabarito: B' ELSE '' END, '\n') AS html""",
    )


def _lowered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole text in lower case, digits and markup signs masked, blanks collapsed."""
    docs = spread(table(spark, sf_dir, "documents"), "doc_id").selectExpr(
        "doc_id", "lang",
        r"regexp_replace(lower(trim(regexp_replace(text, '(?U)\\s+', ' '))), '[0-9<>&()\\[\\]:]', '#') AS low",
    )
    return docs.withColumn("w", F.expr("(length(low) + 2) div 3"))


def container_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lowered(spark, sf_dir).selectExpr(
        "doc_id AS page_id",
        """concat('<html><nav>2001</nav><div class="box question-item"><p class="enunciado">', low,
             '</p>\nA) op ', translate(substr(low, 1, w), 'abcde', '#####'), '\nB) op ',
             translate(substr(low, 1 + w, w), 'abcde', '#####'), '\nComentário: visto em 2019<hr></div></html>') AS html""",
    )


def line_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lowered(spark, sf_dir).selectExpr(
        "doc_id AS page_id", "concat('topo\n', '7) <b>', low, '</b>\n', '8. curto\nfim') AS html"
    )


def unnamed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight documents to a page, as cards or as runs of siblings, among menus and footers; no pattern or
    layout of the library names these elements."""
    blocks = _lowered(spark, sf_dir).withColumn("low", F.coalesce("low", F.lit(""))).selectExpr(
        "doc_id div 8 AS page_id", "doc_id",
        """CASE WHEN (doc_id div 8) % 2 = 0
             THEN concat('<li class="cartao"><span>', doc_id, '</span><p class="t">Questão ', doc_id, ': ', low, '</p><p class="o">(A) alfa ', doc_id,
               '</p><p class="o">(B) beta ', length(low), '</p><p class="o">(C) gama ', doc_id % 7, '</p></li>')
             ELSE concat('<h3>', doc_id, '</h3><blockquote>Questão ', doc_id, ': ', low, '</blockquote><ol><li>alfa ', doc_id,
               '<li>beta ', length(low), '<li>gama ', doc_id % 7, '</ol><hr>') END AS html""")
    return blocks.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "html"))).alias("b")).selectExpr(
        "page_id",
        """concat('<body><div><a href="/">a</a><a href="/b">b</a><a href="/c">c</a></div><main><ul>',
             array_join(transform(b, x -> x.html), '\n'), '</ul></main><footer><p>x</p><p>y</p><p>z</p></footer></body>') AS html""")


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose navigation links become subcategory links, each followed by a topic
    link of the same word."""
    return spread(table(spark, sf_dir, "pages"), "page_id").selectExpr(
        "page_id",
        "regexp_extract(url, '/(en|fr|de|es)/', 1) AS categoria",
        """regexp_replace(html, '<a href="/([^"]*)">([^<]*)</a>',
             concat('<a href="/simulados/', regexp_extract(url, '/(en|fr|de|es)/', 1), '/$1">$2</a><a class="t" href="/simulados/',
                    regexp_extract(url, '/(en|fr|de|es)/', 1), '/$1/x-$1">$2 x</a>')) AS html""",
    )


def image_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose links become images: relative, absolute and repeated ones."""
    return spread(table(spark, sf_dir, "pages"), "page_id").selectExpr(
        "page_id",
        """concat('<div style="background-image: url(''/bg', page_id, '.png'')"></div>',
             replace(replace(html, '<a href="/t', '<img alt="" src="http://cdn/t'), '<a href="/', '<img src="/')) AS html""",
    )


def flag_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the state markers of answer pages added."""
    return spread(table(spark, sf_dir, "pages"), "page_id").selectExpr(
        "page_id",
        """concat(html,
             CASE WHEN page_id % 5 = 0 THEN '<p>Página não encontrada</p>' ELSE '' END,
             CASE WHEN page_id % 7 = 0 THEN '<div id="js-account-not-confirm-modal"></div>' ELSE '' END,
             CASE WHEN page_id % 3 <> 0 THEN concat('<button class="btn js-answer-btn" data-question-id="', page_id,
               '" data-limit-reached="', CASE WHEN page_id % 11 = 0 THEN 'true' ELSE 'false' END, '"',
               CASE WHEN page_id % 2 = 0 THEN ' aria-disabled="true"' ELSE '' END, '>Responder</button>',
               '<button class="js-answer-btn" data-question-id="', page_id, '">x</button>') ELSE '' END,
             CASE WHEN page_id % 6 = 0 THEN '<div id="js-questions-limit-modal">Seu LIMITE diário acabou</div>' ELSE '' END
           ) AS html""",
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer feedback around whole document texts."""
    rows = spread(table(spark, sf_dir, "documents"), "doc_id").withColumn("esc", _escaped("text"))
    return rows.selectExpr(
        "doc_id AS id", "lower(substr('ABCDE', CAST(1 + doc_id % 5 AS INT), 1)) AS marcada",
        """concat('<div><p>', esc, '</p>', CASE doc_id % 4
             WHEN 0 THEN concat('<div class="js-response-wrong">Gabarito: <span class="x js-question-right-answer"> ',
                                substr('EDCBA', CAST(1 + doc_id % 5 AS INT), 1), ' </span></div>')
             WHEN 1 THEN '<span class="js-question-right-answer"></span><div class="js-response-correct">Parabéns!</div>'
             WHEN 2 THEN '<span class="js-question-right-answer" aria-label="b"></span>'
             ELSE '' END, '</div>') AS html""",
    )


def info_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).selectExpr(
        "id",
        """concat(CASE WHEN id % 4 = 0 THEN '' ELSE concat('Ano: ', ano, ' ') END, 'Banca: ', banca, ' Órgão: ', orgao,
             ' Provas: ', orgao, ' - ', ano, ' | ', cargo, ' | ') AS linha""",
    )


def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).selectExpr(
        "id",
        """CASE id % 5 WHEN 0 THEN concat(orgao, ' • ', banca) WHEN 1 THEN concat(' • ', banca, ' • x', ano)
             WHEN 2 THEN '' WHEN 3 THEN concat(orgao, '•', banca, '• 7')
             ELSE concat('  ', orgao, '  •', banca, ' • prova ', ano, '/2') END AS origem""",
    )
