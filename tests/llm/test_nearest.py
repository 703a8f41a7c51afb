import data
import numpy as np
import pytest
from pyspark.sql import functions as F

from quaestor.llm import nearest as n


def truth(vectors, queries, k):
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors])
    for q in queries:
        scores = x @ x[ids == q][0]
        scores[ids == q] = -np.inf
        order = np.lexsort((ids, -scores))[:k]
        yield int(q), [(int(ids[o]), scores[o]) for o in order if ids[o] != q]


@pytest.mark.parametrize("clumps", [0, 5])
def test_recall_and_scores(spark, monkeypatch, clumps):
    monkeypatch.setattr(n, "SAMPLE", 400)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 24)) * rng.uniform(0.5, 2, size=(1500, 1))
    if clumps:
        x = rng.normal(size=(clumps, 24))[rng.integers(0, clumps, 1500)] + 0.05 * x
    vectors = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    rows = n.nearest_neighbours(df, F.col("vec_id") % 20 == 0, k=10).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hit = 0
    for q, want in truth(vectors, range(0, 1500, 20), 10):
        got = found[q]
        assert len(got) == 10 and len({v for v, _ in got}) == 10 and q not in dict(got)
        assert got == sorted(got, key=lambda p: (-p[1], p[0]))
        assert all(abs(s - x[q] @ x[v]) < 1e-9 for v, s in got)
        hit += len({v for v, _ in want} & {v for v, _ in got})
    assert hit / 750 >= 0.9


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, None]),
            (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0, 1.0, 1.0]), (20, [-1.0, 1.0]), (40, None), (None, [1.0, 1.0]), (10, [])]
    df = data.with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in n.nearest_neighbours(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.0), (0, 4, 20, -1.0), (20, 1, 3, 2.0), (20, 2, 0, -1.0), (20, 3, 1, -1.0), (20, 4, 2, -1.0)]
    assert n.nearest_neighbours(data.empty(df), F.col("vec_id") % 20 == 0).count() == 0
    assert n.nearest_neighbours(df.filter("vec_id = 1"), F.col("vec_id") % 20 == 0).count() == 0


def test_scan_without_doubt_is_exact():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 40))
    ids = np.arange(3000)
    q, q_ids = x[:5], ids[:5]
    rotation = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    for row, places, scores in n.scan(q, q_ids, np.full(5, -np.inf), x, ids, rotation, 7):
        exact = x @ q[row]
        exact[row] = -np.inf
        assert len(set(places) & set(np.argsort(-exact)[:7])) >= 6 and np.allclose(scores, exact[places])


def test_equal_vectors_score_the_same_wherever_they_stand():
    """20 to 60 equal vectors among others, in several orders: the smaller ids come first."""
    rng = np.random.default_rng(3)
    rotation = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    for equal in range(20, 61, 5):
        one = rng.normal(size=64)
        for others in (0, 3, 50):
            x = np.concatenate([np.tile(one, (equal, 1)), 0.1 * rng.normal(size=(others, 64))])
            for _ in range(3):
                order = rng.permutation(len(x))
                ids = order.astype(np.int64)
                query = np.array([10_000])
                for _, places, scores in n.scan(one[None, :] + 0.01, query, np.array([-np.inf]), x[order], ids, rotation, 20):
                    assert ids[places].tolist() == list(range(20)) and len(set(scores.tolist())) == 1
                places, scores = n.top_exact(x[order], ids, one + 0.01, 20)
                assert ids[places].tolist() == list(range(20)) and len(set(scores.tolist())) == 1


@pytest.mark.parametrize("equal", [27, 47])
def test_ties_end_to_end_and_reruns(spark, equal):
    one = np.random.default_rng(4).normal(size=64)
    rows = [(i, one.tolist()) for i in range(1, equal + 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    runs = [n.nearest_neighbours(df.repartition(parts), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect() for parts in (1, 5)]
    assert runs[0] == runs[1]
    for q in {r["query_id"] for r in runs[0]}:
        assert [r["vec_id"] for r in runs[0] if r["query_id"] == q] == [i for i in range(1, equal + 1) if i != q][:20]
