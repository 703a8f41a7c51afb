import hashlib
import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quaestor.functions import parsing, text


def one(spark, column, **values):
    kinds = {k: ("map<string,string>" if isinstance(v, dict) else "int" if isinstance(v, int) else "string") for k, v in values.items()}
    schema = ", ".join(f"{k} {t}" for k, t in kinds.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("r")).first()["r"]


def normalized(t):
    return re.sub(r"\s+", " ", t).strip().lower()


def expected_content_hash(t, options):
    body = normalized(t) + "|" + json.dumps(options, sort_keys=True, ensure_ascii=False)
    return hashlib.md5(body.encode()).hexdigest()


@pytest.mark.parametrize("raw", ["  A\u00a0 B\tC\nd ", "ÁÉÍ Ç\u2003x", "a\x1c\x1db", "", "   "])
def test_normalize(spark, raw):
    assert one(spark, text.normalize_text("t"), t=raw) == normalized(raw)


@pytest.mark.parametrize(
    "options",
    [
        {"B": "dois", "A": "um"},
        {"A": 'aspas "x"', "B": "barra \\ e \\u001F", "C": "linha\nnova\ttab"},
        {"A": "\x1f\x0b\x1f", "B": "\\\x1f", "C": "ção", "D": "/"},
        {},
    ],
)
def test_content_hash_equals_python_json(spark, options):
    got = one(spark, text.content_hash("t", "o"), t="Qual  o\nvalor?", o=options)
    assert got == expected_content_hash("Qual  o\nvalor?", options)


def test_content_hash_random(spark):
    chars = st.characters(blacklist_categories=("Cs",), blacklist_characters="\x00")
    rows = []

    @settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.text(alphabet=st.one_of(st.sampled_from(' \\"\n\x1f\x0bAé/u001F'), chars), max_size=12),
           st.dictionaries(st.sampled_from("ABCDE"), st.text(alphabet=st.sampled_from(' \\"\n\x1f\x0b\x1aé/u01F'), max_size=8), max_size=5))
    def collect(statement, options):
        rows.append((statement.lower(), options))

    collect()
    got = spark.createDataFrame(rows, "t string, o map<string,string>").select(
        text.canonical_options("o").alias("c")
    ).collect()
    assert [r["c"] for r in got] == [json.dumps(o, sort_keys=True, ensure_ascii=False) for _, o in rows]


def test_decode(spark):
    assert one(spark, text.decode_options("j"), j='{"A": "x"}') == {"A": "x"}
    assert one(spark, text.decode_list("j"), j='["a","b"]') == ["a", "b"]
    assert spark.sql("select cast(null as string) j").select(text.decode_list("j").alias("r")).first()["r"] == []


def test_names(spark):
    assert one(spark, text.slug("t"), t="Atos Administrativos_x") == "atos-administrativos-x"
    assert one(spark, text.display_name("t"), t="direito-penal") == "Direito Penal"
    assert one(spark, text.file_slug("t", 20), t="Analista Técnico, (TI) Sênior") == "analista_técnico_ti_"[:20]
    assert one(spark, text.corrected_source("f", "q"), f="quadrix_pdf", q="1") == "pci"


def test_page_urls(spark):
    assert one(spark, text.page_url("b", "p"), b="u", p=1) == "u"
    assert one(spark, text.page_url("b", "p"), b="u", p=3) == "u/3"
    assert one(spark, text.search_page_url("b", "p"), b="u?a=1", p=3) == "u?a=1&page=3"
    assert one(spark, text.search_page_url("b", "p"), b="u", p=3) == "u?page=3"


def test_provenance_skips_empty_parts(spark):
    got = one(spark, text.provenance("b", "o", "a", "s"), b="Quadrix", o="", a=0, s="Crase")
    assert got == "Quadrix · Crase"


@pytest.mark.parametrize(
    "raw,want",
    [
        ("Órgão • Banca • 2023", ("Órgão", "Banca", 2023)),
        ("Órgão • Banca", ("Órgão", "Banca", None)),
        ("", (None, None, None)),
        ("Órgão • • 7", ("Órgão", None, None)),
        ("A•B•Prova 12/2020", ("A", "B", 12)),
    ],
)
def test_origin(spark, raw, want):
    assert tuple(one(spark, parsing.parse_origin("t"), t=raw)) == want


def test_info_line(spark):
    line = "Ano: 2023 Banca: Quadrix Órgão: CRM-SC Provas: Quadrix - 2023 - A | Quadrix - 2023 - B | "
    assert one(spark, parsing.parse_info("t"), t=line) == {
        "Ano": "2023", "Banca": "Quadrix", "Órgão": "CRM-SC", "Prova": "Quadrix - 2023 - A | Quadrix - 2023 - B",
    }
    assert one(spark, parsing.parse_info("t"), t="Ano:  Banca: X") == {"Banca": "X"}
    assert one(spark, parsing.parse_info("t"), t="Banca: X Banca: Y") == {"Banca": "Y"}
    assert one(spark, parsing.parse_info("t"), t="nada") == {}


def test_image_urls(spark):
    html = """<p><img src="/a.png"><img alt='x' src='http://h/b.png'><img src="/a.png"></p>
              <div style="color:red; background-image: url('/c.png')"></div>"""
    assert one(spark, parsing.image_urls("t", "http://s"), t=html) == ["http://s/a.png", "http://h/b.png", "http://s/c.png"]


@pytest.mark.parametrize(
    "html,want",
    [
        ('<div class="js-response-wrong">x <span class="js-question-right-answer">C</span></div>', "C"),
        ('<span class="js-question-right-answer" aria-label="d"></span>', "D"),
        ('<span class="js-question-right-answer"></span><div class="js-response-correct">Parabéns</div>', "B"),
        ("<div>nada</div>", None),
    ],
)
def test_feedback(spark, html, want):
    assert one(spark, parsing.answer_from_feedback("t", "m"), t=html, m="b") == want


@pytest.mark.parametrize(
    "html,want",
    [
        ('<button class="btn js-answer-btn" data-limit-reached="true">R</button>', True),
        ('<button class="btn js-answer-btn" data-limit-reached="false">R</button>', False),
        ('<div id="js-questions-limit-modal"><p>Você atingiu o limite diário</p></div>', True),
        ("<p>limite diário citado no texto</p>", False),
    ],
)
def test_limit(spark, html, want):
    assert one(spark, parsing.limit_reached("t"), t=html) is want


def test_page_state(spark):
    assert one(spark, parsing.page_not_found("t"), t="<h1>PÁGINA NÃO ENCONTRADA</h1>") is True
    assert one(spark, parsing.page_not_found("t"), t="<h1>ok</h1>") is False
    assert one(spark, parsing.account_blocked("t"), t='<div id="js-account-not-confirm-modal">') is True
    assert one(spark, parsing.answer_disabled("t"), t='<button class="js-answer-btn" disabled>') is True
    assert one(spark, parsing.answer_disabled("t"), t="<p>") is True
    assert one(spark, parsing.answer_disabled("t"), t='<button class="js-answer-btn">') is False


def test_percent_rounds_half_even(spark):
    rows = [(n, m) for m in range(1, 60) for n in range(0, m + 1)]
    got = spark.createDataFrame(rows, "n int, m int").select("n", "m", text.percent("n", "m").alias("p")).collect()
    assert all(r["p"] == round(100 * r["n"] / r["m"], 1) for r in got)
    assert one(spark, text.percent("n", "m"), n=3, m=0) == 0.0


def test_rewards(spark):
    got = {b["badge"]: b["unlocked"] for b in one(spark, text.badges("n"), n=30001)}
    assert got == {"Penalista": True, "Leitor": True, "Streaker": True, "Sniper": True, "Mestre": False, "Finalista": False}
    assert one(spark, text.experience_points("n"), n=19) == 1


def test_preview_cut(spark):
    assert one(spark, text.strip_tags("t", 4), t=" <b>abc</b>def ") == "abcd"
