import pytest
from pyspark.sql import functions as F

from quaestor.operators import quality
from quaestor.schemas import EXAM_SPECS, QUESTIONS
from quaestor.sources import pages, questions, specs

SPEC = '''# comentário
prova_x:
  nome: "Concurso: X"
  banca: "Banca X"   # banca
  ano: 2024
  orgao: 'Órgão X'
  total_questoes: 30

  cargos:
    "Analista, TI":
      nivel: "superior"
      vagas: 10
      materias:
        "Língua Portuguesa": 10
        Direito Penal: 20

    Técnico:
      nivel: "médio"
      materias:
        "Língua Portuguesa": 5
'''

BOARD = '''instituto_b:
  nome_oficial: "B"
  estilo_visual:
    cores: ["Preto"]
    margens:
      superior_cm: 2.0
  estrutura_disciplinas_padrao:
    - ordem: 1
      nome: "Português / RLM"
      quantidade_questoes: 50
    - ordem: 2
      nome: "Específicos (Direito)"
      quantidade_questoes: 70
'''

TAXONOMY = '''Matemática:
  aritmetica:
    - fracoes
    - percentual
  algebra:
    - equacoes

Direito Penal:
  crimes:
    - dolo
'''


def files(spark, tmp_path, **texts):
    for name, body in texts.items():
        (tmp_path / f"{name}.yaml").write_text(body, encoding="utf-8")
    return specs.read_files(spark, str(tmp_path))


def test_exam_specs(spark, tmp_path):
    got = specs.exam_specs(files(spark, tmp_path, prova_x=SPEC, outro="nao_casa:\n  nome: x\n"))
    assert got.columns == EXAM_SPECS.fieldNames()
    rows = sorted(tuple(r) for r in got.collect())
    head = ("prova_x", "Concurso: X", "Banca X", 2024, "Órgão X", None, 30, None)
    assert rows == [
        (*head, "Analista, TI", "superior", 10, 1, "Língua Portuguesa", 10.0),
        (*head, "Analista, TI", "superior", 10, 2, "Direito Penal", 20.0),
        (*head, "Técnico", "médio", None, 1, "Língua Portuguesa", 5.0),
    ]


def test_same_as_a_yaml_reader(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    got = specs.exam_specs(files(spark, tmp_path, prova_x=SPEC)).collect()
    data = yaml.safe_load(SPEC)["prova_x"]
    want = {(c, m): float(w) for c, job in data["cargos"].items() for m, w in job["materias"].items()}
    assert {(r["cargo"], r["materia"]): r["peso"] for r in got} == want
    assert {(r["nome"], r["banca"], r["ano"], r["orgao"]) for r in got} == {(data["nome"], data["banca"], data["ano"], data["orgao"])}


def test_board_structure_takes_the_only_section(spark, tmp_path):
    got = specs.board_structure(files(spark, tmp_path, b=BOARD, c=BOARD.replace("instituto_b", "c") + "d:\n  x: 1\n"))
    assert sorted(tuple(r) for r in got.collect()) == [
        (b, i, n, q) for b in ("b", "c") for i, n, q in ((1, "Português / RLM", 50), (2, "Específicos (Direito)", 70))
    ]


def test_taxonomy_keeps_file_order(spark, tmp_path):
    got = specs.taxonomy(files(spark, tmp_path, t=TAXONOMY))
    assert sorted(tuple(r) for r in got.collect()) == [
        ("Direito Penal", "crimes", "dolo", 1, 1), ("Matemática", "algebra", "equacoes", 2, 1),
        ("Matemática", "aritmetica", "fracoes", 1, 1), ("Matemática", "aritmetica", "percentual", 1, 2),
    ]


def sample(spark):
    return spark.createDataFrame(
        [(1, 'a "b",\nc', {"A": "x,y"}, ["i"], [], "pci"), (2, "z", {"B": "w"}, [], ["u"], "qconcursos")],
        "id long, enunciado string, alternativas map<string,string>, imagens array<string>, imagens_urls array<string>, fonte string",
    )


def test_append_and_round_trip(spark, tmp_path):
    rows = questions.add_missing_columns(
        sample(spark), QUESTIONS, {"usada": F.lit(0), "materia": F.lit("m"), "hash_enunciado": F.col("id")}
    ).select(QUESTIONS.fieldNames())
    path = str(tmp_path / "bank")
    questions.append_questions(rows, path)
    back = questions.read_questions(spark, path).select(QUESTIONS.fieldNames())
    flat = [c for c in QUESTIONS.fieldNames() if c != "alternativas"]
    assert quality.round_trip_difference(rows.select(flat), back.select(flat)).count() == 0
    assert {r["id"]: r["alternativas"] for r in back.collect()} == {1: {"A": "x,y"}, 2: {"B": "w"}}


def test_stored_json_form(spark):
    stored = questions.encode_stored(sample(spark))
    rows = {r["id"]: (r["alternativas"], r["imagens"], r["imagens_urls"]) for r in stored.collect()}
    assert rows == {1: ('{"A":"x,y"}', '["i"]', "[]"), 2: ('{"B":"w"}', None, '["u"]')}
    back = questions.decode_stored(stored).collect()
    assert {r["id"]: (r["alternativas"], r["imagens"]) for r in back} == {1: ({"A": "x,y"}, ["i"]), 2: ({"B": "w"}, [])}


def test_schema_migration(spark):
    old = spark.createDataFrame([(1, "m")], "id long, materia string")
    assert "cargo" in questions.missing_columns(old, QUESTIONS) and "id" not in questions.missing_columns(old, QUESTIONS)
    new = spark.createDataFrame([(2, "n", "c")], "id long, materia string, cargo string")
    merged = questions.merge_schemas(old, new, {"cargo": F.lit("sem cargo")})
    assert {(r["id"], r["cargo"]) for r in merged.collect()} == {(1, "sem cargo"), (2, "c")}


def test_exports(spark, tmp_path):
    questions.export_csv(sample(spark), str(tmp_path / "csv"), F.col("fonte") == "pci")
    back = questions.read_exported_csv(
        spark, str(tmp_path / "csv"), questions.export_rows(sample(spark)).schema
    ).collect()
    assert [(r["id"], r["enunciado"], r["alternativas"]) for r in back] == [(1, 'a "b",\nc', '{"A":"x,y"}')]
    assert all(p.name.endswith(".gz") for p in (tmp_path / "csv").glob("part-*"))
    questions.export_json(sample(spark), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_page_dumps(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>á\n</p>", encoding="utf-8")
    row = pages.read_page_dumps(spark, str(tmp_path)).first()
    assert row["html"] == "<p>á\n</p>" and row["url"].endswith("a.html")


def test_any_yaml_form_gives_the_same_rows(spark):
    from quaestor.sources import specs

    two = "e1:\n  nome: 'Nome: um'\n  ano: 2024\n  cargos:\n    c1:\n      nivel: medio\n      materias:\n        Direito: 3\n        L\u00edngua: 7\n"
    four = two.replace("  ", "    ")
    flow = "e1: {nome: \"Nome: um\", ano: 2024, cargos: {c1: {nivel: medio, materias: {Direito: 3, 'L\u00edngua': 7}}}}"
    rows = []
    for text in (two, four, flow):
        files = spark.createDataFrame([("e1", text)], "arquivo string, texto string")
        rows.append(sorted(tuple(r) for r in specs.exam_specs(files).select("concurso", "nome", "ano", "cargo", "nivel", "materia", "peso").collect()))
        assert specs.file_faults(files).count() == 0
    assert rows[0] == rows[1] == rows[2] == [("e1", "Nome: um", 2024, "c1", "medio", "Direito", 3.0), ("e1", "Nome: um", 2024, "c1", "medio", "L\u00edngua", 7.0)]
    taxonomies = [spark.createDataFrame([("t", x)], "arquivo string, texto string") for x in ("M:\n    C:\n        - a\n        - b\n", "M: {C: [a, b]}")]
    assert [[tuple(r) for r in specs.taxonomy(t).orderBy("tema").collect()] for t in taxonomies] == [[("M", "C", "a", 1, 1), ("M", "C", "b", 1, 2)]] * 2


def test_bad_files_are_reported(spark):
    from quaestor.sources import specs

    files = spark.createDataFrame([("a", "a: {x: 1"), ("b", "other: {x: 1}"), ("c", "- 1"), ("d", "d: {x: 1}"), ("e", None)], "arquivo string, texto string")
    got = {r["arquivo"]: r["motivo"].split(":")[0] for r in specs.file_faults(files).collect()}
    assert got == {"a": "no_yaml", "b": "other_top_key", "c": "no_keys", "e": "no_keys"}
