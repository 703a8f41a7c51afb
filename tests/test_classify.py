import datetime

from quaestor.operators import classify, quality
from quaestor.plans import stats


def test_title_lookup(spark):
    aliases = spark.createDataFrame(
        [("Língua Portuguesa", 1, "LÍNGUA PORTUGUESA"), ("Língua Portuguesa", 1, "PORTUGUÊS"), ("SUAS", 2, "SUAS"),
         ("Direito Administrativo", 3, "DIREITO ADMINISTRATIVO"), ("Recursos", 4, "LICITAÇ"), ("X", 5, "Z")],
        "materia string, mat_pos int, alias string",
    )
    titles = ["LÍNGUA PORTUGUESA", "  Língua  Portuguesa ", "NOÇÕES DE DIREITO ADMINISTRATIVO", "MATEMÁTICA", "licitações e suas leis", "z"]
    rows = spark.createDataFrame([(t,) for t in titles], "titulo string")
    got = {r["titulo"]: r["materia"] for r in classify.subject_of_title(rows, aliases).collect()}
    assert got == dict(zip(titles, ["Língua Portuguesa", "Língua Portuguesa", "Direito Administrativo", None, "SUAS", "X"]))


def test_category_suggestion(spark):
    keywords = spark.createDataFrame(
        [("P", "orto", 1, ["acento", "crase"]), ("P", "morfo", 2, ["verbo", "pronome"]), ("V", "primeira", 1, [])],
        "materia string, categoria string, cat_pos int, kws array<string>",
    )
    rows = spark.createDataFrame(
        [(1, "P", "O VERBO e o pronome, com crase"), (2, "P", "crase e verbo"), (3, "P", "nada"), (4, "Z", "crase"), (5, "V", "x")],
        "id int, materia string, enunciado string",
    )
    got = {r["id"]: (r["categoria_sugerida"], r["confianca"]) for r in classify.suggest_category(rows, keywords).collect()}
    assert got == {1: ("morfo", 1.0), 2: ("orto", 0.5), 3: ("orto", 0.3), 4: (None, 0.0), 5: ("primeira", 0.3)}
    cut = {r["id"]: r["categoria_sugerida"] for r in classify.suggest_category(rows, keywords, snippet_chars=7).collect()}
    assert cut[1] == "morfo" and cut[2] == "orto"


def test_topic_lookup(spark):
    rules = spark.createDataFrame([("c", "t", "M1"), ("c", None, "M2")], "categoria string, tema string, materia string")
    rows = spark.createDataFrame([("c", "t"), ("c", "u"), ("d", "t"), ("c", None)], "categoria string, tema string")
    got = {(r["categoria"], r["tema"]): r["materia_edital"] for r in classify.subject_of_topic(rows, rules).collect()}
    assert got == {("c", "t"): "M1", ("c", "u"): "M2", ("d", "t"): None, ("c", None): "M2"}


def test_worklists(spark):
    log = spark.createDataFrame([("f", "a", 3, 1), ("f", "b", 5, 1), ("f", "c", 0, 1)], "fonte string, chave string, pagina int, seq long")
    topics = spark.createDataFrame([("f", "a", "u/a"), ("f", "b", "u/b"), ("f", "c", ""), ("f", "n", "u/n")], "fonte string, chave string, base string")
    todo = classify.pages_to_fetch(topics, log, cap=5).collect()
    assert sorted((r["chave"], r["pagina"]) for r in todo if r["chave"] in "abn") == [
        ("a", 4), ("a", 5), ("n", 1), ("n", 2), ("n", 3), ("n", 4), ("n", 5)
    ]
    again = classify.pages_to_revisit(topics, log).collect()
    assert len(again) == 8 and {r["chave"] for r in again} == {"a", "b"}


def test_coverage(spark):
    specs = spark.createDataFrame([("e", "c", "m1", 16.0), ("e", "c", "m2", 0.0)], "concurso string, cargo string, materia string, peso double")
    questions = spark.createDataFrame([("m1", "c")], "materia string, cargo string")
    got = {(r["materia"], r["nivel_total"]): (r["coletadas"], r["percentual"]) for r in classify.coverage(specs, questions).collect()}
    assert got == {("m1", 0): (1, 6.2), ("m2", 0): (0, 0.0), (None, 1): (1, 6.2)}


def test_enrichment_defaults(spark):
    specs = spark.createDataFrame(
        [("e", None, None, 2, 1, "c2"), ("e", None, None, 1, 1, "c1")],
        "concurso string, banca string, orgao string, ordem_cargo int, ordinal int, cargo string",
    )
    rows = spark.createDataFrame([("e", "m")], "concurso string, materia string")
    r = classify.enrich_from_spec(rows, specs).first()
    assert (r["banca"], r["orgao"], r["cargo"], r["assunto"]) == ("QConcursos", "e", "c1", "m")


def test_spec_checks(spark):
    rows = spark.createDataFrame(
        [("a", "b", "c", "m", 1.0), ("a", "b", "c", "m", 2.0), ("x", None, "c", "m", 0.0), ("y", "b", None, None, None)],
        "concurso string, banca string, cargo string, materia string, peso double",
    )
    got = {(r["check"], r["key"]): r["n_bad"] for r in quality.spec_checks(rows).collect()}
    assert got == {
        ("subject_twice", "a"): 1, ("exam_without_board", "x"): 1, ("weight_not_positive", "x"): 1,
        ("job_missing", "y"): 1, ("subject_missing", "y"): 1, ("weight_not_positive", "y"): 1,
    }


def test_streaks(spark):
    def d(n):
        return datetime.date(2024, 3, n)

    rows = [(1, d(1)), (1, d(2)), (1, d(2)), (1, d(5)), (1, d(6)), (1, d(7)), (2, d(1)), (3, d(7))]
    got = {r["user_id"]: (r["maior"], r["atual"]) for r in stats.study_streaks(spark.createDataFrame(rows, "user_id int, dia date")).collect()}
    assert got == {1: (3, 3), 2: (1, 0), 3: (1, 1)}


def test_tree_null_rules(spark):
    rows = spark.createDataFrame(
        [("pci", "c", "t", ["u"]), ("pci", "c", None, ["u"]), ("pci", None, "t", []), ("outra", "c", "t", [])],
        "fonte string, categoria string, tema string, imagens_urls array<string>",
    )
    got = {(r["nivel"], r["categoria"], r["tema"]): (r["total"], r["com_imagens"]) for r in stats.source_tree(rows).collect()}
    assert got == {(0, None, None): (3, 2), (1, "c", None): (2, 2), (2, "c", "t"): (1, 1)}
