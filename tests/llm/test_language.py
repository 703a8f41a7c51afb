import itertools

import data
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quaestor.llm import language as lg


def field():
    rng = np.random.default_rng(0)
    pools = {"en": data.PROSE["en"].split(), "de": data.PROSE["de"].split()}
    texts, labels = [], []
    for k in range(60):
        lang = "en" if k % 2 else "de"
        texts.append(" ".join(rng.choice(pools[lang], 30)))
        labels.append(lang)
    return lg.fit(texts, labels)


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(3)
    f = lg.Field(["a", "b", "c"], np.zeros((1, 3)), np.zeros(0, np.uint64), np.zeros(0, int), np.zeros((1, 3)), rng.normal(size=3), rng.normal(size=(3, 3)))
    lengths = [1, 5, 3, 0, 4]
    evidence = rng.normal(size=(sum(lengths), 3)) * 2
    at = np.append(0, np.cumsum(lengths))
    got = f.marginals(evidence, at)
    for d, n in enumerate(lengths):
        own = evidence[at[d]:at[d + 1]]
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=n):
            if n:
                w = np.exp(f.start[path[0]] + sum(own[t, path[t]] for t in range(n)) + sum(f.transition[a, b] for a, b in zip(path, path[1:])))
                for t in range(n):
                    want[t, path[t]] += w
        if n:
            assert np.allclose(got[at[d]:at[d + 1]], want / want.sum(1, keepdims=True))


def test_training_expectations_are_the_same_sums():
    rng = np.random.default_rng(4)
    evidence, start, move = rng.normal(size=(2, 4, 2)), rng.normal(size=2), rng.normal(size=(2, 2))
    both, pairs = lg.chain_expectations(evidence, start, move)
    total = np.zeros((2, 2))
    for s in range(2):
        weights = {p: np.exp(start[p[0]] + sum(evidence[s, t, p[t]] for t in range(4)) + sum(move[a, b] for a, b in zip(p, p[1:])))
                   for p in itertools.product(range(2), repeat=4)}
        z = sum(weights.values())
        for p, w in weights.items():
            for a, b in zip(p, p[1:]):
                total[a, b] += w / z
    assert np.allclose(pairs, total)


def test_code_switched_words(spark):
    text = data.PROSE["en"] + " " + data.PROSE["de"]
    best, score, runs = lg.identify(field(), pa.array([text]))
    n = len(data.PROSE["en"].split())
    assert [k for k, _ in runs[0]] == [1, 0] and abs(runs[0][0][1] - n) <= 1
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = lg.identify_languages(docs, field(), spans=True).first()["lang_spans"]
    assert [s["lang"] for s in spans] == ["en", "de"] and sum(s["words"] for s in spans) == len(text.split())


def test_awkward_rows(spark):
    docs = data.with_clashes(data.awkward_documents(spark))
    model = lg.language_model(docs, F.col("doc_id").isNotNull())
    rows = lg.identify_languages(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        lettered = any(ch.isalpha() for ch in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not lettered) and 0 <= r["lang_score"] <= 1 and (lettered or r["lang_score"] == 0)
        assert r["text"] != data.PROSE["en"] or r["lang_pred"] == "en"
    nothing = lg.language_model(data.empty(docs), F.lit(True))
    assert {r["lang_pred"] for r in lg.identify_languages(docs, nothing).collect()} == {"und"}
    assert lg.identify_languages(data.empty(docs), model).count() == 0


def test_held_out_accuracy(spark, sf_dir):
    from quaestor.llm.queries import QUERIES

    rows = QUERIES["op9_language_id"](spark, sf_dir).filter("held_out").join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.95


def random_field(rng, languages=3):
    field = lg.empty_field()
    field.languages = [f"l{k}" for k in range(languages)]
    field.weights = rng.normal(size=(lg.CELLS, languages)).astype(np.float32)
    field.lexicon_weights, field.start, field.transition = np.zeros((1, languages)), rng.normal(size=languages), rng.normal(size=(languages, languages))
    return field


def test_runs_with_messages_equal_one_pass(monkeypatch):
    """Texts of no, one, some and very many words, cut every 7 words or not at all."""
    rng = np.random.default_rng(1)
    field = random_field(rng)
    sizes = [0, 1, 6, 7, 8, 14, 0, 100, 2]
    words_at = np.append(0, np.cumsum(sizes))
    evidence = rng.normal(size=(words_at[-1], 3)) * 2
    whole = field.marginals(evidence, words_at)
    monkeypatch.setattr(lg, "RUN", 7)
    assert np.allclose(field.marginals(evidence, words_at), whole, atol=1e-12)


def test_long_text_in_parts_equals_one_pass(monkeypatch):
    rng = np.random.default_rng(2)
    field = random_field(rng)
    text = " ".join("".join(rng.choice(list("abcdé"), rng.integers(1, 9))) for _ in range(3000)) + " " * 900 + "end"
    best, score, runs = lg.identify(field, pa.array([text, "a b"]))
    monkeypatch.setattr(lg, "SLICE", 400)
    monkeypatch.setattr(lg, "RUN", 16)
    again = lg.identify(field, pa.array([text, "a b"]))
    assert best.tolist() == again[0].tolist() and np.allclose(score, again[1], atol=1e-12)
    assert all(np.array_equal(a, b) for a, b in zip(runs, again[2]))


def test_language_of_long_documents_only_is_learned(spark):
    rows = [(i, data.PROSE["en"], "en", "a") for i in range(30)] + [(100 + i, f"{data.PROSE['de']} {i} " * 400, "de", "a") for i in range(6)]
    docs = data.documents(spark, rows)
    texts, labels = lg.training_texts(docs, F.col("doc_id").isNotNull())
    assert labels.count("de") == 6 and labels.count("en") == 30 and max(map(len, texts)) <= lg.TRAIN_BYTES
    got = lg.identify_languages(docs, lg.language_model(docs, F.col("doc_id").isNotNull())).collect()
    assert all(r["lang_pred"] == r["lang"] for r in got)


def test_threshold_of_known_grams_counts_every_text(spark):
    """All texts but the learned ones count: here a tenth of the later ones lie far below the others."""
    from pyspark.sql import functions as F

    from quaestor.llm import language

    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") >= 0, "en").alias("lang"), F.lit("a").alias("text"))
    _, ranked = language.ranked_texts(rows, F.lit(True))
    share = F.when(F.col("_rank") <= language.TRAIN_DOCS, 0.1).when((F.col("_rank") > 1000) & (F.col("_rank") <= 1300), 0.3).otherwise(0.9)
    judged = ranked.select("doc_id", "lang", F.lit("a").alias("text"), share.alias("lang_familiar"))
    assert abs(language.familiar_floor(judged, F.lit(True)) - 0.8 * 0.3) < 1e-3
    assert language.familiar_floor(judged.filter("lang_familiar < 0.2"), F.lit(True)) == 0.0
