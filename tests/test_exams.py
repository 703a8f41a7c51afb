import random

import pytest

from quaestor.operators import allocation, draw, quality
from quaestor.plans import exams

SPEC = "exam string, q int, ordinal int, materia string, peso int"
BANK = "id long, materia string, usada int, content_hash string, fonte string"


def spec_rows(name, q, weights):
    return [(name, q, i, m, w) for i, (m, w) in enumerate(weights)]


def largest_remainder(q, weights):
    total = sum(w for _, w in weights)
    if total == 0:
        return [0] * len(weights)
    exact = [q * w / total for _, w in weights]
    out = [int(x) for x in exact]
    order = sorted(range(len(out)), key=lambda i: -(exact[i] - out[i]))
    for i in order[: q - sum(out)]:
        out[i] += 1
    return out


def test_quotas_equal_the_model(spark):
    rnd, rows, want = random.Random(3), [], {}
    fixed = [
        (60, [("Português", 30), ("Matemática", 20), ("Direito", 10)]), (10, [("A", 1), ("B", 2), ("C", 3)]),
        (10, [("A", 1), ("B", 1), ("C", 1)]), (0, [("A", 5), ("B", 3)]), (7, [("A", 0), ("B", 0)]),
        (1000, [(f"m{i}", i) for i in range(1, 101)]),
    ]
    cases = fixed + [
        (rnd.randint(0, 200), [(f"m{i}", rnd.randint(0, 40)) for i in range(rnd.randint(1, 12))]) for _ in range(200)
    ]
    for k, (q, weights) in enumerate(cases):
        rows += spec_rows(f"e{k}", q, weights)
        for (m, _), n in zip(weights, largest_remainder(q, weights)):
            want[(f"e{k}", m)] = n
    quotas = allocation.largest_remainder(spark.createDataFrame(rows, SPEC))
    assert {(r["exam"], r["materia"]): r["quota"] for r in quotas.collect()} == want
    assert quality.quota_checks(quotas).filter("n_bad > 0").count() == 0


def test_rounded_quota_is_half_even(spark):
    rows = [("e", 5, 1, "a", 1), ("e", 5, 2, "b", 1), ("f", 60, 1, "a", 50), ("f", 60, 2, "b", 70), ("g", 9, 1, "a", 0), ("g", 9, 2, "b", 3)]
    got = allocation.rounded_quota(spark.createDataFrame(rows, "exam string, q int, ordem int, disciplina string, qtd int"))
    assert {(r["exam"], r["disciplina"]): r["quota"] for r in got.collect()} == {
        ("e", "a"): 2, ("e", "b"): 2, ("f", "a"): 25, ("f", "b"): 35, ("g", "b"): 9,
    }


def redistributed(q, rows):
    """rows: (quota, available) in listed order -> extra per row"""
    taken = [min(n, a) for n, a in rows]
    short, extra = q - sum(taken), [0] * len(rows)
    for i in sorted(range(len(rows)), key=lambda i: -rows[i][0]):
        if taken[i] > 0 and short > 0:
            extra[i] = min(short, rows[i][1] - taken[i])
            short -= extra[i]
    return taken, extra


def test_redistribution_equals_the_model(spark):
    rnd, rows, avail, want = random.Random(8), [], [], {}
    for k in range(200):
        n = rnd.randint(1, 6)
        q = rnd.randint(1, 40)
        quotas = largest_remainder(q, [(str(i), rnd.randint(0, 5)) for i in range(n)])
        stock = [rnd.choice([0, rnd.randint(0, 30)]) for _ in range(n)]
        taken, extra = redistributed(q, list(zip(quotas, stock)))
        for i in range(n):
            rows.append((f"e{k}", q, i, f"{k}-{i}", quotas[i]))
            avail.append((f"{k}-{i}", stock[i]))
            want[f"{k}-{i}"] = (taken[i], extra[i])
    got = allocation.redistribute(
        spark.createDataFrame(rows, "exam string, q int, ordinal int, materia string, quota long"),
        spark.createDataFrame(avail, "materia string, disponiveis long").filter("disponiveis > 0"),
    )
    assert {r["materia"]: (r["taken"], r["extra"]) for r in got.collect()} == want


def random_bank(rnd, subjects, size, contents=None):
    rows, i = [], 0
    for s in subjects:
        for _ in range(rnd.randint(0, size)):
            i += 1
            digest = f"{rnd.randint(0, contents):08x}" if contents else f"{rnd.getrandbits(64):016x}"
            rows.append((i, s, int(rnd.random() < 0.3), digest, rnd.choice(["qconcursos", "pci", "quadrix_pdf"])))
    return rows


def drawn(bank, subject, n, ok=lambda r: True):
    """One draw: unused contents by digest, then used ones."""
    out, rank = [], {"qconcursos": 1, "pci": 2}
    for used in (0, 1):
        best = {}
        for r in bank:
            if r[1] == subject and r[2] == used and ok(r):
                key = (rank.get(r[4], 3), r[0])
                if r[3] not in best or key < best[r[3]][0]:
                    best[r[3]] = (key, r[0])
        out += [best[d][1] for d in sorted(best)][: n - len(out)]
    return out


def test_draw_equals_the_model(spark):
    rnd = random.Random(1)
    subjects = [f"s{i}" for i in range(12)]
    bank = random_bank(rnd, subjects, 25, contents=20)
    requests = [(f"e{k}", s, rnd.randint(0, 20)) for k in range(15) for s in rnd.sample(subjects, 4)]
    got = {}
    for r in draw.draw(spark.createDataFrame(bank, BANK), spark.createDataFrame(requests, "exam string, materia string, n int")).collect():
        got.setdefault((r["exam"], r["materia"]), []).append((r["rank"], r["id"]))
    for exam, s, n in requests:
        assert [i for _, i in sorted(got.get((exam, s), []))] == drawn(bank, s, n)


def test_packing_equals_one_draw_after_the_other(spark):
    """60 independent subjects, exams beyond the end of every pool."""
    rnd = random.Random(11)
    subjects = [f"s{i}" for i in range(60)]
    bank = random_bank(rnd, subjects, 20)
    quotas = [(f"e{k}", k, s, rnd.randint(0, 7)) for k in range(9) for s in subjects if rnd.random() < 0.8]
    want, state = {}, {r[0]: r for r in bank}
    for exam, _, s, n in sorted(quotas, key=lambda x: x[1]):
        ids = drawn(list(state.values()), s, n)
        want[(exam, s)] = ids
        for i in ids:
            state[i] = (*state[i][:2], 1, *state[i][3:])
    got = {}
    packed = draw.pack_exams(
        spark.createDataFrame(bank, BANK), spark.createDataFrame(quotas, "exam string, exam_pos int, materia string, n int")
    )
    for r in packed.collect():
        got.setdefault((r["exam"], r["materia"]), []).append((r["pos"], r["id"]))
    for key, ids in want.items():
        assert [i for _, i in sorted(got.get(key, []))] == ids, key
    assert set(got) <= set(want)


def test_board_exam_equals_the_model(spark):
    rnd = random.Random(4)
    subjects = ["a", "b", "c"]
    bank = random_bank(rnd, subjects, 12, contents=14)
    structure = []
    for k in range(10):
        for i in range(rnd.randint(1, 4)):
            structure.append((f"e{k}", 5 + k, i, rnd.choice(subjects + ["none"]), rnd.randint(0, 4)))
    got = {}
    for r in exams.board_exams(
        spark.createDataFrame(bank, BANK), spark.createDataFrame(structure, "exam string, q int, ordem int, disciplina string, qtd int")
    ).collect():
        got.setdefault(r["exam"], []).append((r["pos"], r["id"]))
    for k in range(10):
        rows = [r for r in structure if r[0] == f"e{k}"]
        q, total = 5 + k, sum(r[4] for r in rows) or 1
        ids = []
        for r in rows:
            n = round(q * r[4] / total)
            ids += [i for i in (drawn(bank, r[3], n) if n > 0 else []) if i not in ids]
        merged = [(b[0], "all", *b[2:]) for b in bank]
        everything = drawn(merged, "all", 10_000)
        ids += [i for i in everything if i not in ids][: max(0, q - len(ids))]
        assert [i for _, i in sorted(got.get(f"e{k}", []))] == ids[:q]


def test_job_exam_filters_and_empty_result(spark):
    bank = spark.createDataFrame(
        [(1, "a", 0, "01", "pci", "o1", "c1", "b1"), (2, "a", 0, "02", "pci", "o1", "c1", "b2"), (3, "a", 0, "03", "pci", "o2", "c1", "b1")],
        BANK + ", orgao string, cargo string, banca string",
    )
    specs = spark.createDataFrame(
        [("x", 5, "o1", "c1", "b1", "a", 1, 1), ("y", 5, "o1", "c1", None, "a", 1, 1), ("z", 5, "o3", "c1", None, "a", 1, 1)],
        "exam string, q int, orgao string, cargo string, banca string, materia string, ordinal int, peso int",
    )
    items = exams.job_exams(bank, specs)
    assert sorted((r["exam"], r["id"]) for r in items.collect()) == [("x", 1), ("y", 1), ("y", 2)]
    summary = {r["exam"]: (r["questoes"], r["minutos"]) for r in exams.exam_summary(specs, items).collect()}
    assert summary == {"x": (1, 3), "y": (2, 6), "z": (0, 0)}


def test_seed_changes_the_order_only(spark):
    rnd = random.Random(2)
    bank = spark.createDataFrame(random_bank(rnd, ["a"], 400) or [(1, "a", 0, "x", "pci")], BANK)
    requests = spark.createDataFrame([("e", "a", 5)], "exam string, materia string, n int")
    plain, one, again = (sorted(r["id"] for r in draw.draw(bank, requests, seed=s).collect()) for s in (None, "1", "1"))
    assert one == again and len(one) == len(plain) == min(5, bank.count())


def test_sheet_numbers_over_sections(spark):
    questions = spark.createDataFrame(
        [(1, "b", "E1", {"B": "y", "A": "x"}, "A", "c1", None, None, None, None, "txt", None),
         (2, "a", "E2", {"A": "x"}, None, "c2", "Q", "O", 2020, "S", None, ["i"])],
        "id long, materia string, enunciado string, alternativas map<string,string>, gabarito string, comentario string, banca string, "
        "orgao string, ano int, assunto string, texto_associado string, imagens array<string>",
    )
    items = spark.createDataFrame([("e", 1, "b", 1), ("e", 2, "a", 1)], "exam string, id long, materia string, rank int")
    sheet = exams.exam_sheet(items, questions, "materia", "rank")
    rows = sheet.orderBy("numero").collect()
    assert [(r["numero"], r["id"], r["secao_titulo"]) for r in rows] == [(1, 2, "A"), (2, 1, "B")]
    assert rows[0]["origem"] == "Q · O · 2020 · S" and rows[0]["chamada_texto"] == "Texto para a questão 1."
    assert [tuple(o) for o in rows[1]["opcoes"]] == [("A", "x"), ("B", "y")]
    key = {r["numero"]: (r["resposta"], r["comentario"]) for r in exams.answer_key(sheet).collect()}
    assert key == {1: (exams.MISSING_ANSWER, ""), 2: ("A", "c1")}


@pytest.mark.parametrize("filters,want", [({}, [1, 2, 3]), ({"banca": "x"}, [1]), ({"banca": "", "cargo": "c"}, [1, 2])])
def test_draw_filters(spark, filters, want):
    rows = spark.createDataFrame(
        [(1, "m", "x", "o", "c", "h"), (2, "m", "y", "o", "c", "h"), (3, "m", "y", "o", "d", "h"), (4, "m", "x", "o", "c", None)],
        "id long, materia string, banca string, orgao string, cargo string, content_hash string",
    )
    assert sorted(r["id"] for r in draw.matching(rows, materia="m", **filters).collect()) == want


def test_text_search(spark):
    rows = spark.createDataFrame([(1, "A crase e a vírgula"), (2, "crase crase a"), (3, "decrase a")], "id long, enunciado string")
    got = draw.search_text(rows, ["Crase", "a"], top=5).collect()
    assert [(r["id"], r["score"]) for r in got] == [(1, 3), (2, 3)]
