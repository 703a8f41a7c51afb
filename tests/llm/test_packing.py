import itertools
import random

import data
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaestor.llm import packing as p
from quaestor.llm.queries import tokenizer_path


def fewest(lengths, room):
    """Exhaustive: sequences needed, by subsets."""
    n = len(lengths)
    best = {0: (0, room)}  # subset -> (sequences, used of the last)
    for subset in range(1, 1 << n):
        options = []
        for i in range(n):
            if subset >> i & 1:
                k, used = best[subset ^ (1 << i)]
                options.append((k, used + lengths[i]) if used + lengths[i] <= room else (k + 1, lengths[i]))
        best[subset] = min(options)
    return best[(1 << n) - 1][0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9), st.integers(30, 60))
def test_as_few_as_exhaustive(lengths, room):
    packed = p.pack_lengths(lengths, room)
    assert sorted(itertools.chain(*packed)) == sorted(lengths)
    assert all(sum(f) <= room for f in packed)
    assert len(packed) == fewest(lengths, room)


def test_search_beats_best_fit():
    rng, better = random.Random(5), 0
    for _ in range(300):
        lengths = sorted((rng.randint(8, 60) for _ in range(rng.randint(8, 24))), reverse=True)
        fit, packed = p.best_fit_decreasing(lengths, 100), p.pack_lengths(lengths, 100)
        assert sorted(itertools.chain(*packed)) == sorted(lengths) and all(sum(f) <= 100 for f in packed)
        assert len(packed) <= len(fit)
        better += len(packed) < len(fit)
    assert better > 0


def test_word_table_equals_tokenizer():
    with open(tokenizer_path(), encoding="utf-8") as file:
        words = p.WordTokenizer(file.read())
    pieces = ["a", "B", "\u00c9", "e\u0301", "\u0130", "\u00df", "\u03a3", "'s", "'", ".", ",", "..", "!", "23", "\x1c", "\x85", "\u00a0", "  ", "\n", "\u65e5\u672c",
              "<|endoftext|>", "\u0149", "_", "\u0301", "\U0001f600", ".a", "Word", "WORD."]
    rng = random.Random(3)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    assert list(words.ids(texts)) == words.encode(words.tokenizer, texts)


def test_parts_are_encoded_once():
    """Case and what stands behind a word make no new entries; added tokens and small forms of two characters stay whole."""
    with open(tokenizer_path(), encoding="utf-8") as file:
        words = p.WordTokenizer(file.read())
    texts = ["Word word, WORD### word.", "", "\u00e9t\u00e9.", "a<|ENDOFTEXT|>b", "c<|endoftext|>d.", "\u0130!\u0301", "H\u0331.", "x\u00d7."]
    want = words.encode(words.tokenizer, texts)
    assert list(words.ids(texts[:3])) == want[:3]
    assert set(words.known) == {"word", ",", "###", ".", "\u00e9t\u00e9"}
    assert list(words.ids(texts)) == want and [next(words.ids([t])) for t in texts] == want


@pytest.mark.parametrize("room", [16, 4096])
def test_whole_table(spark, room):
    docs = data.with_clashes(data.awkward_documents(spark))
    pieces = p.tokenized_pieces(docs, tokenizer_path(), room)
    rows = p.pack_pieces(pieces, room).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = []
    for r in docs.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want += [(str(r["doc_id"]), k, at, ids[at:at + room]) for k, at in enumerate(range(0, len(ids), room))]
    got = [(str(r["doc_id"]), r["piece"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in rows]
    assert sorted(got) == sorted(want)
    by_sequence = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert r["offset"] == by_sequence.get(r["sequence_id"], 0)
        by_sequence[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by_sequence.values()) <= room


def test_sequences_hold_their_pieces(spark):
    docs = data.awkward_documents(spark)
    packed = p.pack_pieces(p.tokenized_pieces(docs, tokenizer_path(), 64), 64)
    total = packed.agg(F.sum("length")).first()[0]
    rows = p.sequences(packed).collect()
    assert sum(len(r["ids"]) for r in rows) == 4 * total and all(sum(r["lengths"]) * 4 == len(r["ids"]) for r in rows)
    assert p.pack_pieces(p.tokenized_pieces(data.empty(docs), tokenizer_path()).limit(0)).count() == 0


@pytest.mark.parametrize("low,high,room", [(80, 130, 641), (100, 190, 1409), (300, 820, 4096)])
def test_sequences_of_many_pieces(low, high, room):
    """Five to twelve pieces a sequence, where best fit is not optimal: most of its excess goes."""
    rng, fit, packed, bound = random.Random(2), 0, 0, 0
    for _ in range(4):
        lengths = sorted((rng.randint(low, high) for _ in range(400)), reverse=True)
        got = p.pack_lengths(lengths, room)
        assert sorted(itertools.chain(*got)) == sorted(lengths) and all(sum(f) <= room for f in got)
        fit, packed, bound = fit + len(p.best_fit_decreasing(lengths, room)), packed + len(got), bound + p.Completion(lengths, room).bound
    assert fit > bound and 2 * (packed - bound) <= fit - bound


def test_fillings_of_any_number():
    search = p.Completion([500, 401, 402, 403, 404, 405, 406, 407], 4096)
    assert next(search.fillings(3328)) == [500, 407, 406, 405, 404, 403, 402, 401]
    assert next(p.Completion([3, 3, 3, 3, 3, 10], 15).fillings(15)) == [3] * 5
