import data
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quaestor.llm import quality as q


def test_statistics_by_hand():
    x = dict(zip(q.STATISTICS, q.column_statistics(pa.array(["Ab ab, AB CD\nab ab", None, ""])).T))
    assert np.allclose(x["log_words"], [np.log1p(6), 0, 0])
    assert np.isclose(x["word_length"][0], 13 / 6) and np.isclose(x["distinct_words"][0], 5 / 6)
    assert np.isclose(x["same_as_before"][0], 1 / 6) and np.isclose(x["capital_words"][0], 2 / 6)
    assert np.isclose(x["ends_in_stop"][0], 1 / 6) and np.isclose(x["words_per_line"][0], 3)
    assert all(np.isfinite(v).all() for v in x.values())


def test_traversal_equals_following_each_tree():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = q.fit(x, y, trees=20, depth=3, rate=0.3)

    def follow(row):
        total = model.start
        for feature, threshold, value in zip(model.feature, model.threshold, model.value):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-total))

    scores = model.score(x)
    assert np.allclose(scores, [follow(r) for r in x])
    assert ((scores > 0.5) == (y > 0.5)).mean() > 0.9


def test_one_class_and_none():
    assert q.fit(np.zeros((3, 2)), np.ones(3)).score(np.zeros((1, 2)))[0] > 0.99
    assert q.fit(np.zeros((0, 2)), np.zeros(0)).score(np.zeros((1, 2)))[0] == 0.5


def test_awkward_rows(spark):
    docs = data.with_clashes(data.awkward_documents(spark))
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (7, 1), (9, 0), (3, None), (None, 1), (4, 0)], "doc_id long, quality int")
    model = q.quality_model(docs, labels, F.lit(True))
    rows = q.quality_scores(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["text"] in (None, "")}) == 1
    assert q.quality_scores(data.empty(docs), model).count() == 0
    assert q.quality_model(data.empty(docs), labels, F.lit(True)).start == 0


def test_held_out_accuracy(spark, sf_dir):
    from quaestor.llm.queries import QUERIES

    labels = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/labels.parquet")
    rows = QUERIES["op2_quality_classifier"](spark, sf_dir.replace("0.001", "0.01")).filter("held_out").join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9
