import random
import re
from collections import Counter

import data
import numpy as np
import pytest

from quaestor.llm import queries, spelling as s


def edits(a, b):
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts, ratio):
    forms = {}
    for w in counts:
        near = [v for v in counts if edits(w, v)]
        best = min(near, key=lambda v: (-counts[v], v)) if near else None
        linked = best is not None and counts[best] >= ratio * counts[w]
        forms[w] = (best if linked else None, len(near), counts[best] if linked else None)
    out = set()
    for w, (form, near, form_n) in forms.items():
        root = w
        while forms[root][0] is not None:
            root = forms[root][0]
        out.add((w, form, root, counts[w], near, form_n))
    return out


def vocabulary(rng, n):
    letters = "abcdeé日"
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(0, 7))) for _ in range(n)}
    words |= {"".join(rng.sample("abcdefg", 7)) for _ in range(60)}  # of one vector
    words |= {"Word", "word", "wörd", "\U0001f600ab", "\U0001f600b"}
    return {w: rng.choice([1, 1, 2, 3, 4, 8, 16, 50]) for w in words}


@pytest.mark.parametrize("sample,cell,leaf", [(65_536, 32_768, 48), (200, 20, 4), (17, 3, 1)])
def test_equals_brute_force(spark, monkeypatch, sample, cell, leaf):
    """Also with many cells, blocks and leaves."""
    monkeypatch.setattr(s.tree_pairs, "__defaults__", (leaf,))
    counts = vocabulary(random.Random(3), 700)
    rows = [(w, n) for w, n in counts.items()]
    df = data.with_clashes(spark.createDataFrame(rows + [(None, 5)], "word string, n long")).repartition(6)
    got = {tuple(r) for r in s.variant_forms(df, 2, sample, cell).collect()}
    assert got == brute(counts, 2)


def test_repeated_words_add_up_and_empty_tables(spark):
    df = spark.createDataFrame([("house", 2), ("house", 3), ("houses", 1), ("mouse", 9)], "word string, n long")
    got = {tuple(r) for r in s.variant_forms(df).collect()}
    assert got == brute({"house": 5, "houses": 1, "mouse": 9}, 2) | set()
    assert s.variant_forms(df.limit(0)).count() == 0


def test_boxes_leave_nothing_out():
    rng = np.random.default_rng(1)
    points, queries = rng.integers(0, 3, (500, 40)).astype(np.int16), rng.integers(0, 3, (90, 40)).astype(np.int16)
    points[:100] = points[0]  # cannot be cut
    queries[:30] = points[200:230]
    queries[np.arange(30), rng.integers(0, 40, 30)] += 1
    for radius in (1, 2, 30):
        want = set(zip(*np.nonzero(np.abs(queries[:, None] - points[None]).sum(2) <= radius)))
        got = [pair for q, p in s.tree_pairs(points, queries, radius, 8) for pair in zip(q, p)]
        assert len(got) == len(set(got)) and set(got) == want


def test_pairs_of_very_long_words():
    """Their distances are beyond 16 bits."""
    points, queries = np.zeros((3, 40), np.int16), np.zeros((2, 40), np.int16)
    points[0, 0], points[1, 0], points[2, 1] = 30_000, 29_999, 30_000
    queries[0, 0], queries[1, 1] = 30_000, 30_000
    got = {pair for q, p in s.tree_pairs(points, queries, 1) for pair in zip(q.tolist(), p.tolist())}
    assert got == {(0, 0), (0, 1), (1, 2)}


def test_runs_too_short_for_a_word_are_not_listed(spark, sf_dir, monkeypatch):
    """Half of all runs have fewer than five letters and can't become words."""
    patterns = []
    monkeypatch.setattr(queries, "word_counts", lambda docs, pattern, cut: patterns.append(pattern) or s.word_counts(docs, pattern, cut))
    queries.op12_spelling_variants(spark, sf_dir)
    assert [re.findall(p, "the house x été élève abcdef1abcd") for p in patterns] == [["house", "élève", "abcdef"]]


def test_counts_of_runs(spark):
    df = spark.createDataFrame([("Été ÉTÉ été-x1y",), (None,), ("",), ("aa aA AA b×c",)], "text string")
    got = {r["word"]: r["n"] for r in s.word_counts(df, r"[A-Za-zÀ-ÿ]+").collect()}
    assert got == Counter({"Été": 1, "ÉtÉ": 1, "été": 1, "x": 1, "y": 1, "aa": 3, "b×c": 1})


def test_roots_of_long_chains(spark):
    links = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(40)], "word string, root string")
    assert {r["root"] for r in s.follow(links).collect()} == {"w40"}
