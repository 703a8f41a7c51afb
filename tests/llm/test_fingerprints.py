import hashlib
import re

import data
from pyspark.sql import functions as F

from quaestor.llm import fingerprints as fp
from quaestor.llm.order import cyclic_predecessors
from quaestor.llm.queries import op3_fingerprints


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def test_estimates_against_sets(spark):
    texts = [" ".join(f"w{i}" for i in range(a, b)) for a, b in ((0, 60), (20, 90), (500, 540), (0, 3000), (1000, 4000), (0, 3))] + ["", None]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    df = fp.sketch_columns(df, {"x": F.col("a"), "y": F.col("b")})
    x, y = F.col("x"), F.col("y")
    for r in df.select("a", "b", fp.resemblance(x, y).alias("r"), fp.containment(x, y).alias("c"), fp.distinct_shingles(x).alias("n"),
                       (fp.as_text(x) == fp.as_text(y)).alias("same")).collect():
        s, t = shingles(r["a"]), shingles(r["b"])
        small = len(s | t) <= fp.K
        want = len(s & t) / len(s | t) if s | t else 1.0
        assert abs(r["r"] - want) < (1e-9 if small else 0.2)
        if small or len(s) * min(1, fp.K / max(1, len(t))) >= 20:
            assert abs(r["c"] - (len(s & t) / len(s) if s else 1.0)) < (1e-9 if small else 0.3)
        assert abs(r["n"] - len(s)) <= (0 if len(s) < fp.K else 0.4 * len(s))
        assert r["same"] == (s == t)


def test_merging_parts_gives_the_whole(spark):
    parts = [("k", " ".join(f"w{i}" for i in range(a, a + 300))) for a in range(0, 1200, 300)]
    df = fp.sketch_columns(spark.createDataFrame(parts, "k string, t string"), {"s": F.col("t")})
    merged = fp.merge_sketches(df, ["k"], "s").first()["s"]
    hashes = sorted({h for r in fp.sketch_columns(df.select("k", "t"), {"s": F.col("t")}, k=10**6).collect() for h in r["s"]})
    assert merged == hashes[:fp.K]


def test_predecessors(spark):
    df = spark.createDataFrame([(i,) for i in (5, 1, 9, 9, -2, None)], "doc_id long")
    assert {r["doc_id"]: r["before"] for r in cyclic_predecessors(df).collect()} == {-2: 9, 1: -2, 5: 1, 9: 5}
    assert cyclic_predecessors(df.limit(0)).count() == 0


def test_edited_texts(spark, tmp_path):
    docs = data.awkward_documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = op3_fingerprints(spark, str(tmp_path)).collect()
    assert len(rows) == docs.count()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect() if r["doc_id"] is not None}
    order = sorted(texts)
    for r in rows:
        if r["doc_id"] is None:
            continue
        text, following = texts[r["doc_id"]], texts[order[(order.index(r["doc_id"]) + 1) % len(order)]]
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(text), shingles(following)
        assert abs(r["near_next"] - (len(a & b) / len(a | b) if a | b else 1.0)) < 0.25
    prints = {}
    for r in rows:
        prints.setdefault((texts.get(r["doc_id"]), r["doc_id"] is None), set()).add(r["fingerprint"])
    assert all(len(p) == 1 for (t, none), p in prints.items() if not none)
