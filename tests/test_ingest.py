import os
import random

from pyspark.sql import functions as F

from quaestor.operators import conflicts, ingest

ROW = "seq long, id_qc string, hash_enunciado string"


def first_wins(rows, bank=()):
    codes, digests, kept = {c for c, _ in bank if c}, {d for _, d in bank}, []
    for seq, code, digest in sorted(rows):
        if (code and code in codes) or digest in digests:
            continue
        if code:
            codes.add(code)
        digests.add(digest)
        kept.append(seq)
    return kept


def stored(spark, rows, bank=None):
    df = spark.createDataFrame(rows, ROW)
    b = spark.createDataFrame(bank, "id_qc string, hash_enunciado string") if bank else None
    return sorted(r["seq"] for r in ingest.insert_if_new(df, b).collect())


def test_chain(spark):
    rows = [(1, "A", "1"), (2, "B", "1"), (3, "B", "2"), (4, "C", "2")]
    assert stored(spark, rows) == [1, 3] == first_wins(rows)


def test_null_codes_never_collide(spark):
    assert stored(spark, [(1, None, "x"), (2, None, "y"), (3, None, "x")]) == [1, 2]


def test_long_chain(spark):
    """Each stored row frees the next but one: as many rounds as pairs."""
    rows = [(i, f"c{(i + 1) // 2}", f"d{i // 2}") for i in range(1, 25)]
    assert stored(spark, rows) == first_wins(rows)


def pending_rows(spark, rows):
    return spark.createDataFrame(rows, ROW).select(F.col("seq").alias("s"), F.col("id_qc").alias("c"), F.col("hash_enunciado").alias("d"))


def test_long_chain_by_doubling(spark, monkeypatch):
    """Without the task that decides a component at once: a logarithmic number of stored steps."""
    steps = []
    store = conflicts.durable
    monkeypatch.setattr(conflicts, "durable", lambda df, label="step": steps.append(label) or store(df, label))
    n = int(os.environ.get("CHAIN", 100_000))
    chain = spark.range(1, n + 1).selectExpr("id AS s", "concat('c', (id + 1) div 2) AS c", "concat('d', id div 2) AS d")
    got = conflicts.accept(conflicts.durable(chain), task_rows=10).agg(F.count("*"), F.sum("s"), F.sum(F.col("s") % 2)).first()
    assert tuple(got) == (n // 2, (n // 2) ** 2, n // 2)  # every other row
    assert len(steps) < 30


def test_chains_and_components_equal_one_by_one(spark):
    """Histories of many shapes with every mix of limits, so that each step has rows to decide."""
    rnd, rows = random.Random(9), []
    order = list(range(1, 1201))
    rnd.shuffle(order)
    for k, s in enumerate(order):
        group = k // 60
        if group % 3 == 0:  # paths in any order
            rows.append((s, f"c{k // 2}", f"d{(k + 1) // 2}-{group}"))
        elif group % 3 == 1:  # many rows to a code
            rows.append((s, f"c{group}-{rnd.randint(0, 3)}", f"d{group}-{rnd.randint(0, 40)}"))
        else:
            rows.append((s, None if rnd.random() < 0.3 else f"c{group}-{rnd.randint(0, 25)}", f"d{group}-{rnd.randint(0, 25)}"))
    first = {}
    for s, c, d in sorted(rows):
        first.setdefault((c, d), s)
    folded = [(s, c, d) for (c, d), s in first.items()]
    want = first_wins(folded)
    for task_rows, plain in ((1, 0), (1, 1), (15, 0), (40, 1), (10_000, 2)):
        got = conflicts.accept(conflicts.durable(pending_rows(spark, folded)), task_rows=task_rows, plain_rounds=plain)
        assert sorted(r["s"] for r in got.collect()) == want, (task_rows, plain)


def test_components(spark):
    rows = [(1, "a", "1"), (2, "a", "2"), (3, "b", "2"), (4, None, "9"), (5, None, "8"), (6, "z", "8")]
    got = {r["s"]: r["component"] for r in conflicts.components(conflicts.durable(pending_rows(spark, rows))).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}


def test_random_histories(spark):
    """300 independent small histories in one table."""
    rnd, rows, bank, want = random.Random(5), [], [], []
    seq = 0
    for trial in range(300):
        n = rnd.randint(1, 12)
        keys = rnd.randint(1, 5)
        mine = []
        for _ in range(n):
            seq += 1
            code = None if rnd.random() < 0.2 else f"{trial}-c{rnd.randint(1, keys)}"
            mine.append((seq, code, f"{trial}-d{rnd.randint(1, keys)}"))
        known = [(f"{trial}-c{rnd.randint(1, keys)}", f"{trial}-d{rnd.randint(1, keys)}")] if rnd.random() < 0.4 else []
        rows += mine
        bank += known
        want += first_wins(mine, known)
    rnd.shuffle(rows)
    assert stored(spark, rows, bank) == sorted(want)


def test_bank_without_codes_or_digests_in_common(spark):
    assert stored(spark, [(1, "A", "1"), (2, "B", "2"), (3, None, "3")], [("A", "9"), (None, "3")]) == [2]


def test_quarantine_reasons(spark):
    rows = spark.createDataFrame(
        [(1, "pci", "e", {"A": "x"}), (2, "outra", "e", {"A": "x"}), (3, None, "e", {"A": "x"}), (4, "pci", "e", {}), (5, "pci", "", {"A": "x"})],
        "id int, fonte string, enunciado string, alternativas map<string,string>",
    )
    good, bad = ingest.split_quarantine(rows)
    assert [r["id"] for r in good.collect()] == [1]
    assert {r["id"]: r["motivo"] for r in bad.collect()} == {
        2: "invalid_source", 3: "invalid_source", 4: "no_options", 5: "no_statement",
    }


def test_progress_last_write_wins(spark):
    log = spark.createDataFrame([("pci", "k", 9, 1), ("pci", "k", 3, 2)], "fonte string, chave string, pagina int, seq long")
    assert ingest.latest_progress(log).first()["ultima_pagina"] == 3


def test_usage_after_reset(spark):
    log = spark.createDataFrame([(1, 1), (2, 2), (None, 3), (2, 4)], "question_id long, seq long")
    assert [r["id"] for r in ingest.used_ids(log).collect()] == [2]
    none = spark.createDataFrame([(1, 1)], "question_id long, seq long")
    assert [r["id"] for r in ingest.used_ids(none).collect()] == [1]


def test_answers_last_update_wins(spark):
    bank = spark.createDataFrame([("Q1", None, "velho"), ("Q2", "A", "c"), (None, None, None)], "id_qc string, gabarito string, comentario string")
    upd = spark.createDataFrame([("Q1", "B", "x", 1), ("Q1", "C", None, 2), (None, "D", "y", 3)], "id_qc string, gabarito string, comentario string, seq long")
    got = {r["id_qc"]: (r["gabarito"], r["comentario"]) for r in ingest.set_answers(bank, upd).collect()}
    assert got == {"Q1": ("C", None), "Q2": ("A", "c"), None: (None, None)}


def test_text_filled_once(spark):
    schema = "id_qc string, texto_associado string, imagens array<string>"
    bank = spark.createDataFrame([("Q1", None, None), ("Q2", "tem", None), ("Q3", "", []), ("Q4", None, ["i"])], schema)
    upd = spark.createDataFrame(
        [("Q1", "", None, 1), ("Q1", "a", None, 2), ("Q1", "b", ["x"], 3), ("Q2", "n", None, 4), ("Q3", None, ["y"], 5), ("Q4", "n", None, 6)],
        schema + ", seq long",
    )
    got = {r["id_qc"]: (r["texto_associado"], r["imagens"], r["preenchida"]) for r in ingest.fill_associated_text(bank, upd).collect()}
    assert got == {"Q1": ("a", None, True), "Q2": ("tem", None, False), "Q3": (None, ["y"], True), "Q4": (None, ["i"], False)}


def test_number_rows_sparse_order(spark):
    rows = spark.range(500).select((F.col("id") * F.col("id") * 99_991_337).alias("seq"))
    got = ingest.number_rows(rows, start=11).orderBy("seq").collect()
    assert [r["id"] for r in got] == list(range(11, 511))


def test_legacy_rows(spark):
    rows = spark.createDataFrame(
        [(1, "Q1", "a", '{"A": "x"}', "quadrix_pdf", '["i"]'), (2, "Q2", "b", "{bad", "pci", None), (3, None, "c", '{"A": "x"}', "quadrix_pdf", ""),
         (4, "Q4", "a", '{"B": "y"}', "pci", None), (5, "Q5", "e", '{"A": "x"}', "pci", "[oops"), (6, "Q6", "f", "{}", "pci", None)],
        "seq long, id_qc string, enunciado string, alternativas string, fonte string, imagens string",
    )
    got = {r["seq"]: (r["status"], r["fonte"], r["erro"]) for r in ingest.import_legacy(rows).collect()}
    assert got == {
        1: ("inserted", "pci", None), 2: ("error", "pci", "bad_options_json"), 3: ("inserted", "quadrix_pdf", None),
        4: ("duplicate", "pci", None), 5: ("error", "pci", "bad_images_json"), 6: ("inserted", "pci", None),
    }
