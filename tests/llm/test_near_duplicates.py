import random

import data
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quaestor.llm import near_duplicates as nd


def shingle_set(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute_force(rows, width, percent):
    """row -> smallest id reachable"""
    sets = [shingle_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and None not in (rows[i][0], rows[j][0]) and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[root(i)] = min(low.get(root(i), doc), doc)
    return [(doc, len(sets[i]), None if doc is None else low[root(i)]) for i, (doc, _) in enumerate(rows)]


def check(spark, rows, width=3, percent=85):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in nd.near_duplicates(df, width, percent).collect()]
    assert sorted(got, key=str) == sorted(brute_force(rows, width, percent), key=str)


def edited(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("block", [512, 7])
def test_groups_of_copies_chains_and_loners(spark, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK_ROWS", block)
    rng = random.Random(block)
    rows, ids = [], iter(rng.sample(range(10**6), 400))
    for group in range(4):
        base = [f"g{group}w{i}" for i in range(120)]
        rows += [(next(ids), edited(base, rng, rng.choice([0, 0, 1, 2, 4, 9]))) for _ in range(30)]
    chain = [f"c{i}" for i in range(200)]
    for step in range(12):  # each link of the chain holds, its ends are far apart
        rows.append((next(ids), " ".join(chain)))
        chain[step * 12] = f"x{step}"
        chain[step * 12 + 6] = f"y{step}"
    rows += [(next(ids), " ".join(f"l{rng.randrange(10**6)}" for _ in range(50))) for _ in range(20)]
    check(spark, rows)


def test_awkward_rows(spark):
    rows = [(r["doc_id"], r["text"]) for r in data.awkward_documents(spark).collect()]
    check(spark, rows)
    check(spark, rows, 5, 80)
    clashing = data.with_clashes(data.awkward_documents(spark))
    got = nd.near_duplicates(clashing).collect()
    assert len(got) == len(rows) and all(r["kept"] for r in got if r["doc_id"] is None or r["n_shingles"] == 0)
    assert nd.near_duplicates(data.empty(clashing)).count() == 0


def test_words_are_parted_by_six_characters_only(spark):
    check(spark, [(1, "A b\x0bC\x0cd\te"), (2, "a B c D\r\nE"), (3, "a b c d e"), (4, "É x"), (5, "é x")])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1), min_size=1, max_size=8))
def test_intersection_sizes(sets):
    import numpy as np

    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    shared = nd.shared_counts(arrays, columns=4)
    assert [[len(a & b) for b in sets] for a in sets] == [[shared[i, j] if i != j else len(sets[i]) for j in range(len(sets))] for i in range(len(sets))]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, pairs):
    got = {r["node"]: r["root"] for r in nd.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    assert got == {x: root(x) for x in parent if root(x) != x}
