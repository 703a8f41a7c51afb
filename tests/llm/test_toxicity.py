import itertools
import random

import data
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quaestor.llm import toxicity as t


def shapes(*texts):
    counts = t.column_counts(pa.array(list(texts)), np.zeros(0, np.uint64), t.known_lists())
    return [{name: int(n) for name, n in zip(t.SHAPES, row) if n and name != "words"} for row in counts]


def test_voters_by_hand():
    assert shapes("You idiot, you are stupid!!!", "the 1d10t and the m0ron", "an idiooot speaks", "nothing to see", None, "") == [
        {"insult_plain": 2, "insult_addressed": 2, "exclaiming": 1}, {"insult_disguised": 2}, {"insult_disguised": 1}, {}, {}, {}]
    assert shapes("STOP SHOUTING now", "idiot***, erbärmlich", "a shot was fired", "Idiot. one two three four five six you") == [
        {"shouting": 2}, {"insult_plain": 1, "contempt_plain": 1}, {}, {"insult_plain": 1}]


def test_pattern_counts_equal_a_loop():
    texts = ["Abcdefgh abcdefgh abcd xyz", "", None, "ABCDEFG-abcdefghij"]
    pieces = [piece for _, piece in t.read_slices(pa.array(texts))]
    hashes = np.unique(np.concatenate([h for piece in pieces for _, h in piece.beginnings()]))
    counts = t.column_counts(pa.array(texts), hashes, t.known_lists())[:, len(t.SHAPES):]
    for row, text in enumerate(texts):
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        assert counts[row].sum() == sum(1 + sum(len(w) > n for n in t.BEGINNINGS) for w in words)


def exact_posterior(prior, parent, chance, votes):
    odds = []
    for label in (0, 1):
        p = prior if label else 1 - prior
        for v, u in enumerate(parent):
            fires = chance[v][label][votes[u] if u >= 0 else 0]
            p *= fires if votes[v] else 1 - fires
        odds.append(p)
    return odds[1] / sum(odds)


def test_posteriors_and_accuracies_equal_enumeration():
    rng = np.random.default_rng(2)
    parent = np.array([-1, 0, 1, 0, 3])
    model = t.LabelModel(0.2, parent, rng.uniform(0.05, 0.95, (5, 2, 2)))
    model.chance[0][:, 1] = model.chance[0][:, 0]
    votes = np.array(list(itertools.product([0, 1], repeat=5)))
    want = [exact_posterior(0.2, parent, model.chance, v) for v in votes]
    assert np.allclose(model.posterior(votes), want)

    def joint(v, label):
        p = 0.2 if label else 0.8
        for k, u in enumerate(parent):
            fires = model.chance[k][label][v[u] if u >= 0 else 0]
            p *= fires if v[k] else 1 - fires
        return p

    for k, accuracy in enumerate(model.accuracy()):
        fired = [(joint(v, 0), joint(v, 1)) for v in votes if v[k]]
        assert np.isclose(accuracy, sum(b for _, b in fired) / sum(a + b for a, b in fired))


def test_label_model_finds_accuracies_and_copies_of_a_voter(spark):
    """Six voters of known accuracy, one of them a copy of another; few labels."""
    rng = np.random.default_rng(5)
    n = 20_000
    y = rng.random(n) < 0.2
    hit, miss = [0.9, 0.7, 0.6, 0.8, 0.5], [0.02, 0.05, 0.1, 0.01, 0.3]
    votes = np.column_stack([np.where(y, rng.random(n) < a, rng.random(n) < b) for a, b in zip(hit, miss)])
    votes = np.column_stack([votes, np.where(rng.random(n) < 0.97, votes[:, 1], ~votes[:, 1])])
    packed = (votes.astype(np.int64) << np.arange(6)).sum(1)
    label = np.where(np.arange(n) < 600, y.astype(float), np.nan)
    df = spark.createDataFrame([(int(v), None if np.isnan(x) else float(x), 1.0) for v, x in zip(packed, label)], "votes long, label double, weight double")
    model = t.fit_label_model(df.groupBy("votes", "label").agg(F.sum("weight").alias("weight")), 6)
    assert model.parent[5] == 1 or model.parent[1] == 5
    for k in range(5):
        assert abs(model.accuracy()[k] - 0.2 * hit[k] / (0.2 * hit[k] + 0.8 * miss[k])) < 0.08
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.95


def test_logistic_regression_meets_its_optimum():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 3))
    y = 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.0] + 0.3)))
    model = t.fit_linear(x, y, ridge=1e-9)
    assert np.allclose(model.score(x), y, atol=1e-4)
    assert t.fit_linear(np.zeros((0, 2)), np.zeros(0)).score(np.zeros((1, 2)))[0] == 0.5
    assert t.fit_linear(np.ones((3, 2)), np.ones(3)).score(np.ones((1, 2)))[0] > 0.99


def test_awkward_rows(spark):
    docs = data.with_clashes(data.awkward_documents(spark))
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (7, 1), (9, 0), (3, None), (None, 1), (4, 0), (10, 0), (-3, 0)], "doc_id long, toxic int")
    model = t.toxicity_model(docs, labels, F.lit(True))
    rows = t.toxicity_scores(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["text"] in (None, "")}) == 1
    assert len({r["score"] for r in rows if r["doc_id"] == 2}) == 1
    assert t.toxicity_scores(data.empty(docs), model).count() == 0
    for known, share in ((labels.limit(0), 0.5), (labels.filter("doc_id = 1"), 1.0), (labels.filter("doc_id = 9"), 0.0)):
        plain = t.toxicity_model(docs, known, F.lit(True))
        assert {round(r["score"], 3) for r in t.toxicity_scores(docs, plain).collect()} == {share}


def test_unlabelled_and_copied_texts(spark):
    """A third of all rows are copies of one clean text; labels for few. Planted abuse is found."""
    rng = random.Random(7)
    calm = "the river and the house stood by a long road where many people went to see them".split()
    bad = ["scum", "worthless", "zorblat", "grumfek"]

    def text(i):
        words = [rng.choice(calm) for _ in range(30)]
        if i % 6 == 0:
            for _ in range(3):
                words[rng.randrange(30)] = rng.choice(bad)
        return " ".join(words)

    rows = [(i, text(i)) for i in range(600)] + [(1000 + i, "the same old text") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(0, 600, 2)] + [(1000, 0)], "doc_id long, toxic int")
    model = t.toxicity_model(docs, labels, F.lit(True))
    scores = {r["doc_id"]: r["score"] for r in t.toxicity_scores(docs, model).collect()}
    assert np.mean([(scores[i] >= 0.3) == (i % 6 == 0) for i in range(600)]) > 0.98
    assert all(scores[1000 + i] < 0.3 for i in range(300))
    assert len(model.report()) == len(model.voters) and max(a for _, a, _ in model.report()) > 0.9


@pytest.mark.parametrize("sf", ["0.1"])
def test_held_out_accuracy(spark, sf_dir, sf):
    from quaestor.llm.queries import op11_toxicity

    folder = sf_dir.replace("0.001", sf)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = op11_toxicity(spark, folder).filter("held_out").join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.97
    assert np.mean([r["predicted"] for r in rows if r["toxic"] == 1]) > 0.9
    assert np.mean([r["predicted"] for r in rows if r["toxic"] == 0]) < 0.01
