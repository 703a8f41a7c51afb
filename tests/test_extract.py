from pyspark.sql import functions as F

from quaestor.operators import extract

SITE_A = """<html><body>
<div class="sim-questao" data-sid="10"><div class="x texto-associado-1">Leia <b>isto</b>.<img src="/t.png"></div>
 <a class="sim-prova-link">Órgão • Banca • 2023</a><p class="sim-enunciado"> Qual &lt;x&gt;? </p>
 <button class="btn btn-sim-alt" data-letra="A"><b>A</b> um</button><button class="btn-sim-alt" data-letra="B">B  dois</button>
 <button class="btn-sim-alt" data-letra="">sem letra</button><span style="background-image: url('http://h/bg.png')"></span></div>
<div class="sim-questao" data-sid="11"><p class="sim-enunciado">sem opções</p></div>
<div class="sim-questao" data-sid="12"><button class="btn-sim-alt" data-letra="A">A x</button></div>
<div class="sim-questao"><p class="sim-enunciado">sem id</p><button class="btn-sim-alt" data-letra="A">A x</button></div>
<div class="other sim-questao" data-sid="13"><p class="sim-enunciado">simples</p><button class="btn-sim-alt" data-letra="C">C três</button>
</body></html>"""

SITE_B = """<div class="q-question-item"><div class="q-id">Questão Q123</div>
 <div class="q-question-breadcrumb"><a>Português</a><a>Crase , </a></div>
 <div class="q-question-info">Ano: 2021 Banca: B1 Órgão: O1 Prova: P1 |</div>
 <div id="q123-text" class="collapse show"><p>Base</p><img src="b.png"></div>
 <div class="q-question-enunciation">Qual  a
 certa?</div>
 <label class="q-radio-button"><span class="q-option-item">A</span><div class="q-item-enum">Alta</div></label>
 <label class="q-radio-button"><div>segunda</div></label></div>
<div class="q-question-item"><div class="q-id">sem código</div><div class="q-question-enunciation">x</div></div>"""


def pages(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page_id long, html string")


def test_site_a(spark):
    rows = extract.questions_site_a(pages(spark, SITE_A, "", "<p>nada</p>")).orderBy("pos").collect()
    assert [(r["id_qc"], r["pos"]) for r in rows] == [("10", 0), ("13", 1)]
    q = rows[0].asDict()
    assert q["enunciado"] == "Qual <x>?" and q["alternativas"] == {"A": "um", "B": "dois"}
    assert (q["orgao"], q["banca"], q["ano"], q["prova"]) == ("Órgão", "Banca", 2023, "Órgão • Banca • 2023")
    assert q["texto_associado"] == "Leia isto ." and q["imagens"] == ["/t.png"]
    assert q["imagens_urls"] == [extract.SITE_A_IMAGES + "/t.png", "http://h/bg.png"]
    assert rows[1]["texto_associado"] == "" and rows[1]["prova"] is None


def test_site_b(spark):
    (q,) = extract.questions_site_b(pages(spark, SITE_B)).collect()
    assert (q["id_qc"], q["materia_qc"], q["assunto"], q["ano"]) == ("Q123", "Português", "Crase", 2021)
    assert (q["banca"], q["orgao"], q["prova"]) == ("B1", "O1", "P1")
    assert q["enunciado"] == "Qual a certa?" and q["alternativas"] == {"A": "Alta", "B": "segunda"}
    assert q["texto_associado"] == "Base" and q["imagens"] == ["b.png"]


def test_numbered_layout(spark):
    page = "topo\n1. Um enunciado <b>longo</b> aqui\nA) alfa\nB) beta\nGabarito: b\n2) curto\nA) alfa\nB) beta\n3. outro enunciado bem longo\nA) x\nB) beta\nGab. C"
    rows = extract.questions_by_pattern(pages(spark, page), extract.LAYOUTS["numbered"]).collect()
    assert [(r["enunciado"], r["alternativas"], r["gabarito"]) for r in rows] == [
        ("Um enunciado longo aqui", {"A": "alfa", "B": "beta"}, None)
    ]
    marked = page.replace("Gabarito: b", "Gabarito: B")
    assert extract.questions_by_pattern(pages(spark, marked), extract.LAYOUTS["numbered"]).first()["gabarito"] == "B"
    assert extract.questions_by_pattern(pages(spark, page), extract.LAYOUTS["numbered"], max_chars=5).first()["enunciado"] == "Um en"


def test_lines_layout_caps_only_on_request(spark):
    page = "\n".join(f"{i}. enunciado número suficiente" for i in range(30)) + "\n[5. x"
    df = pages(spark, page)
    assert extract.questions_by_pattern(df, extract.LAYOUTS["lines"]).count() == 30
    assert extract.questions_by_pattern(df, extract.LAYOUTS["lines"], max_blocks=20).count() == 20


def listing(spark, html, cat="penal"):
    return spark.createDataFrame([(1, cat, html)], "page_id long, categoria string, html string")


def test_hierarchy(spark):
    html = """<a href="/simulados/penal/crimes/dolo">Dolo</a> <a class=x href="/simulados/penal/crimes">Crimes</a>
      <a href="/simulados/penal/penas/">Penas &amp; Medidas</a><a href="/simulados/penal/crimes/dolo">Dolo</a>
      <a href="/simulados/penal/crimes/culpa/">Culpa</a><a href="/simulados/civil/x">Civil</a><a href="/simulados/penal/penas?p=2">n</a>"""
    got = sorted((r["sub"], r["sub_nome"], r["sub_url"], r["tema"], r["tema_url"]) for r in extract.hierarchy(listing(spark, html)).collect() if r["tema"])
    assert got == [
        ("crimes", "Crimes", "/simulados/penal/crimes", "culpa", "/simulados/penal/crimes/culpa/"),
        ("crimes", "Crimes", "/simulados/penal/crimes", "dolo", "/simulados/penal/crimes/dolo"),
    ]
    rest = [(r["sub"], r["sub_nome"], r["sub_url"]) for r in extract.hierarchy(listing(spark, html)).collect() if not r["tema"]]
    assert rest == [("penas", "Penas & Medidas", "/simulados/penal/penas/")]
    urls = {r["tema"]: r["url"] for r in extract.topic_urls(listing(spark, html)).collect()}
    assert urls == {"dolo": "/simulados/penal/crimes/dolo", "culpa": "/simulados/penal/crimes/culpa/"}


def test_missing_page_has_no_hierarchy(spark):
    html = '<h1>Página não encontrada</h1><a href="/simulados/penal/crimes">Crimes</a>'
    assert extract.hierarchy(listing(spark, html)).count() == 0


def test_sql_function(spark):
    extract.register_sql(spark)
    pages(spark, SITE_A).createOrReplaceTempView("site_a")
    rows = spark.sql("SELECT t.id_qc FROM site_a, LATERAL extract_questions(html) t").collect()
    assert sorted(r["id_qc"] for r in rows) == ["10", "13"]


def test_surplus_options_and_broken_pages(spark):
    label = '<label class="q-radio-button"><div>o{}</div></label>'
    six = SITE_B.split("<label")[0] + "".join(label.format(i) for i in range(6)) + "</div>"
    (q,) = extract.questions_site_b(pages(spark, six)).collect()
    assert q["alternativas"] == {"A": "o0", "B": "o1", "C": "o2", "D": "o3", "E": "o4"}
    broken = ["<div class='q-question-item'>", "<", "<div class=q-question-item><label class='q-radio-button'", "</div></div>", "<![x", None]
    assert extract.questions_site_b(pages(spark, *broken)).count() == 0


def test_a_page_that_cannot_be_read_is_reported(spark, monkeypatch):
    from quaestor.operators import html_blocks

    pb = __import__("pyarrow").RecordBatch.from_pydict({"page_id": [1, 2], "html": ["<div class='sim-questao' data-sid='1'></div>", "x"]})
    plain = html_blocks.read_marks

    def failing(html, layout):
        if html == "x":
            raise ValueError("no page")
        return plain(html, layout)

    monkeypatch.setattr(html_blocks, "read_marks", failing)
    (out,) = html_blocks.mark_pages("a", ["page_id"])(iter([pb]))
    assert out.column("fault").to_pylist() == [None, "ValueError: no page"] and len(out.column("blocks")[0]) == 1
    assert extract.page_faults(pages(spark, SITE_A), "a").count() == 0


def test_entities_in_links(spark):
    html = """<a href="/simulados/penal/crimes/no&ccedil;&otilde;es">No&ccedil;&#245;es &#x26; mais</a>"""
    (r,) = [r for r in extract.hierarchy(listing(spark, html)).collect()]
    assert (r["tema_nome"], r["tema_url"]) == ("Noções & mais", "/simulados/penal/crimes/noções")


def test_answer_state_belongs_to_the_block(spark):
    block = "<div class='q-question-item'><div class='q-id'>Q{0}</div>{1}</div>"
    button = "<button class='btn js-answer-btn' data-question-id='{0}'{1}>Responder</button>"
    html = button.format(9, "") + "".join(block.format(n, b) for n, b in (
        (1, button.format(11, "")), (2, button.format(12, " aria-disabled='true'")), (3, button.format(13, " disabled")),
        (4, button.format(14, " data-limit-reached=\"true\"")), (5, "")))
    got = [tuple(r)[1:] for r in extract.answer_states(pages(spark, html)).orderBy("numero").collect()]
    assert got == [("1", "11", True), ("2", "12", False), ("3", "13", False), ("4", "14", False), ("5", None, False)]


def test_each_pattern_is_evaluated_once_per_piece_of_text(spark):
    """Lambdas put their argument in wherever it is used; the steps keep costly ones apart."""
    def uses(layout, pattern):
        rows = extract.page_blocks(pages(spark, SITE_A), layout)
        return rows._jdf.queryExecution().optimizedPlan().toString().count(pattern)

    assert uses("a", "trim(") == 2 and uses("a", "url\\(") == 1  # pieces, and what is left of options
    assert uses("b", "(?U)\\s+,") == 1 and uses("b", "trim(") == 2


def test_strips_what_unicode_calls_space(spark):
    import re
    import sys

    spaces = [chr(c) for c in range(sys.maxunicode) if re.match(r"\s", chr(c)) and chr(c) not in "\x1c\x1d\x1e\x1f"]
    assert sorted(extract.SPACE) == spaces
    rows = spark.createDataFrame([(c + "a b" + c,) for c in spaces], "t string")
    assert {r[0] for r in rows.select(extract._strip(F.col("t"))).collect()} == {"a b"}


def test_sql_function_takes_few_pages_at_once(spark):
    """Workers are sent batches of bounded size, not all pages of a task as one Arrow batch."""
    extract.register_sql(spark)
    pages(spark, *[SITE_A] * 300).coalesce(1).createOrReplaceTempView("site_a_many")
    rows = spark.sql("SELECT page_id, t.* FROM site_a_many, LATERAL extract_questions(html) t")
    assert "ArrowEvalPythonUDTF" not in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 600
    first = rows.orderBy("page_id", "pos").first()
    assert first["alternativas"] == {"A": "um", "B": "dois"} and first["imagens"] == ["/t.png"] and first["origem"] == "Órgão • Banca • 2023"


def test_options_are_searched_once(spark):
    rows = extract.questions_by_pattern(pages(spark, "x\n1. Qual a capital do estado?\nA) um dois\nB) três\nC)\nD) a C) b\nGabarito: B\n"), extract.LAYOUTS["numbered"])
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1
    assert rows.first()["alternativas"]["A"] == "um dois"
