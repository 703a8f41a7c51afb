import random
import re
from collections import Counter

import data
import numpy as np
import pyarrow as pa
import pytest

from quaestor.llm import phrases as p


def brute(rows, least, most, top):
    """lang -> ranked rows, by counting every phrase of every text."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i:i + k])] += 1
    out = set()
    for lang, found in counts.items():
        candidates = {w: f for w, f in found.items() if len(w) > 1 and f >= least}
        kept = []
        for w, a in candidates.items():
            inside = any(len(g) > len(w) and 100 * f >= 100 * a and any(g[i:i + len(w)] == w for i in range(len(g) - len(w) + 1)) for g, f in candidates.items())
            if not inside:
                score, _, left, right = min((1000 * a * totals[lang] // (found[w[:k]] * found[w[k:]]), k, found[w[:k]], found[w[k:]]) for k in range(1, len(w)))
                kept.append((-score, -a, " ".join(w).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return out


def texts(rng, n):
    words = ["the", "a", "old", "New", "house", "river", "été", "日本", "x1", "of", "--"]
    passage = "by the old river of the new house we went"
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!? "]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "de", None, "und"]), text + (passage if i % 3 == 0 else "") if rng.random() < 0.9 else None))
    return rows + [("en", passage)] * n  # a third and more of all rows are copies


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    return {tuple(r) for r in p.collocations(data.with_clashes(df), **options).collect()}


@pytest.mark.parametrize("paths,burst,waiting", [(400_000, 4096, 1 << 19), (60, 5, 40)])
def test_equals_brute_force(spark, monkeypatch, paths, burst, waiting):
    """Also with tries that burst and spill all the time."""
    monkeypatch.setattr(p, "PATHS", paths)
    monkeypatch.setattr(p, "WAITING", waiting)
    monkeypatch.setattr(p.HatTrie.__init__, "__defaults__", (burst,))
    rows = texts(random.Random(1), 150)
    for least, top in ((3, 10), (12, 2000)):
        assert found(spark, rows, least=least, top=top) == brute(rows, least, 5, top)


def test_trie_of_any_order_and_limits():
    rng = np.random.default_rng(0)
    ids = rng.integers(1, 6, (4000, 5)).astype(np.uint64) << np.uint64(40)
    ids[np.arange(5)[None, :] >= rng.integers(1, 6, 4000)[:, None]] = 0
    want = Counter(tuple(r) for r in ids.tolist())
    trie, got = p.HatTrie(5, burst=7), Counter()
    for part in np.array_split(ids, 13):
        trie.add(part)
        if trie.size > 300:
            keys, counts = trie.cut(trie.largest(0.5))
            got.update(dict(zip(map(tuple, keys.tolist()), [0] * len(keys))))
            for key, count in zip(keys.tolist(), counts.tolist()):
                got[tuple(key)] += count
            assert [tuple(k) for k in keys.tolist()] == sorted(tuple(k) for k in keys.tolist())
    keys, counts = trie.cut(list(trie.roots))
    for key, count in zip(keys.tolist(), counts.tolist()):
        got[tuple(key)] += count
    assert got == want and trie.size == 0 and not trie.roots


def test_runs_leave_the_trie_in_parts():
    """A run of very many paths is no one batch, and no list of so many Python objects."""
    class Passed:
        value = p.Filter(np.full(1 << 10, ~np.uint64(0))), None

    rng = np.random.default_rng(3)
    text = " ".join(f"w{i}" for i in rng.integers(0, 3000, 250_000))
    got, paths = Counter(), []
    for out in p.phrase_counter(Passed, 0, 2, 2)(iter([pa.RecordBatch.from_pydict({"lang": ["en"], "text": [text]})])):
        assert out.num_rows < 2 * 65_536
        pairs = out.column("path").flatten().to_numpy().view(np.uint64).reshape(-1, 2)
        paths += map(tuple, pairs.tolist())
        got.update(dict(zip(map(tuple, pairs.tolist()), out.column("f").to_pylist())))
    ids = p.slice_words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), np.array([p.language_seed("en", 0)], np.uint64))[-1]
    assert got == Counter(zip(ids[:-1].tolist(), ids[1:].tolist())) and paths == sorted(set(paths)) and len(paths) > 200_000


def test_long_text_in_parts(monkeypatch):
    """A text cut into parts has the same windows as the whole."""
    monkeypatch.setattr(p, "SLICE", 200)
    rng = random.Random(2)
    text = "".join(rng.choice(["ab", "c", "longerword", "é"]) + rng.choice([" ", ". ", "\n", "   "]) for _ in range(2000)) + "x" * 3000 + " end"
    seeds = np.array([5], np.uint64)

    def windows(parts):
        out = Counter()
        for _, bytes_, offsets, limit in parts:
            starts, _, _, piece, ids = p.slice_words(bytes_, offsets, seeds)
            size = p.windows(ids, piece, np.ones(max(len(ids) - 1, 0), bool), 5)
            if limit is not None:
                size[starts >= limit] = 0
            out.update(map(tuple, p.window_rows(ids, size, 1, 5).tolist()))
        return out

    parts = list(p.slices(pa.array([text])))
    whole = np.frombuffer(text.encode(), np.uint8)
    assert len(parts) > 20 and windows(parts) == windows([(0, whole, np.array([0, len(whole)]), None)])


@pytest.mark.parametrize("n,size", [(0, 1 << 10), (5, 1 << 10), (1500, 1 << 15), (40_000, 1 << 20), (120_000, 1 << 20)])
def test_filter_comes_to_the_driver_in_blocks(spark, monkeypatch, n, size):
    """A row for each block of 64-bit words, not one for each word: those of a large filter fill the driver."""
    rows = []
    frame = type(spark.range(0))
    for name in ("collect", "toPandas"):
        monkeypatch.setattr(frame, name, lambda self, f=getattr(frame, name): rows.append(len(out := f(self))) or out)
    keys = p.mix(np.arange(n, dtype=np.uint64))
    want = np.zeros(size // 64, np.uint64)
    for k in range(p.PROBES):
        at = p.probe(keys, k) & np.uint64(size - 1)
        np.bitwise_or.at(want, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    df = spark.createDataFrame(keys.view(np.int64), "key long") if n else spark.createDataFrame([], "key long")
    found = p.filter_of(df, 1 << 20)
    assert found.size == size and (found.bits == want).all() and found.has(keys).all()
    assert sum(rows) <= 16


def test_words_that_share_an_id_are_told_apart(spark, monkeypatch):
    """Where two words have one id under a seed, everything is counted under the next."""
    calls = []
    table = p.word_table

    def clashing(texts, seed):
        calls.append(seed)
        out = table(texts, seed)
        return out.withColumn("clash", p.F.lit(True)) if seed == 0 else out

    monkeypatch.setattr(p, "word_table", clashing)
    rows = texts(random.Random(4), 40)
    assert found(spark, rows, least=5) == brute(rows, 5, 5, 2000) and calls == [0, 1]


def test_empty_and_null(spark):
    df = spark.createDataFrame([(None, None), ("en", ""), ("en", " .,\n "), (None, "one")], "lang string, text string")
    assert p.collocations(df, least=1).count() == 0
    assert p.collocations(df.limit(0)).count() == 0
    assert {r["lang"] for r in p.collocations(spark.createDataFrame([(None, "a b")] * 3, "lang string, text string"), least=2).collect()} == {"und"}
