"""Phrase collocations: HAT-trie counting of word windows, scored by their weakest cut.

Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line breaks, and pieces into
words. Phrases are counted in three passes over whole texts, each pass only where the one before
found something frequent: words, pairs of frequent words, then runs of three to five words whose
pairs are all frequent. No phrase can be frequent without that, so nothing is lost.

A task counts in a HAT-trie. Words are 64-bit ids; a window of words is a path. The top of the
trie branches by word id; below, a container is a hash table from the rest of the path to its
count. A container that grows beyond ``BURST`` paths bursts: it becomes a trie node with a
smaller container for each next word. Windows go in sorted and counted by the half million. When the trie holds ``PATHS`` paths, the largest subtrees, half
of all paths, are written out as sorted runs and dropped from it.
Runs are rows of phrase ids and counts; Spark merges those of one phrase, dealt by the phrase,
so that a word or passage that occurs everywhere has a few rows per task and no partition of its
own. A phrase is a path's beginning too, so a run carries the sums of every node of its subtree.

Which words and pairs are frequent is told to the tasks by a Bloom filter of at most
``FILTER_BITS`` bits: what it lets through in excess is counted for nothing and falls out later.
Ids of words are hashes of language and word; the table of words is checked for two words of one
id, in which case everything is counted again with another seed.

Null texts are empty, null languages ``und``; rows without an id count like others, and repeated
rows each time. A text longer than a slice is read in parts that overlap by a window, so memory
does not grow with it. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.llm.words import LOWER, mix, text_slices, word_hashes
from quaestor.session import durable, ship_package

MOST_WORDS = 5
BURST = 4_096
PATHS = 400_000
#: windows that are sorted and counted together before they go into the trie
WAITING = 1 << 19
#: paths that are Python objects on their way into the trie or out of it at once
RUN = 1 << 16
SLICE = 1 << 20
FILTER_BITS = 1 << 26
PROBES = 3
#: words of 64 bits of a filter that come to the driver as one row
BLOCK = 1 << 10
UNKNOWN = "und"

_BYTE = np.arange(256)
BREAK = np.isin(_BYTE, [*b".,;:!?", 10, 11, 12, 13])
GAP = BREAK | np.isin(_BYTE, [0x20, 0x09])


# --- words of a slice --------------------------------------------------------------------

def parts_of(data: np.ndarray, words: int, size: int) -> Iterator[tuple[np.ndarray, int | None]]:
    """A long text in parts: bytes, and the place in them before which windows begin (None: all).
    A part ends at a gap and the next one begins with its last ``words`` - 1 words again."""
    start = 0
    while True:
        end = min(start + size, len(data))
        while end < len(data):
            gaps = np.flatnonzero(GAP[data[start:end]])
            begins = gaps[np.append(~GAP[data[start + gaps[:-1] + 1]], False)] + 1 if len(gaps) else gaps
            if len(begins) >= words:
                # the words from the last but ``words`` on are whole up to the last gap
                begin = int(begins[-words])
                yield data[start:start + int(gaps[-1])], begin
                start += begin
                break
            end = min(len(data), start + 2 * (end - start))
        else:
            yield data[start:end], None
            return


def slices(texts: pa.Array, words: int = MOST_WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray, int | None]]:
    """(first row, bytes, offsets, place before which windows begin) of consecutive rows."""
    for row, data, offsets in text_slices(texts, SLICE):
        if len(offsets) > 2 or len(data) <= 2 * SLICE:
            yield row, data, offsets, None
            continue
        for part, limit in parts_of(data, words, SLICE):
            yield row, part, np.array([0, len(part)]), limit


def language_seed(lang: str, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{lang}".encode(), digest_size=8).digest(), "little")


def slice_words(data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, row, piece and id of every word of a slice. ``seeds``: of each row's language."""
    data = LOWER[data]
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = GAP[data]
    first = np.zeros(len(data) + 1, bool)  # where a row begins
    first[offsets] = True
    starts = np.flatnonzero(~gap[1:-1] & (gap[:-2] | first[:-1]))
    ends = np.flatnonzero(~gap[1:-1] & (gap[2:] | first[1:])) + 1
    row = np.searchsorted(offsets, starts, side="right") - 1
    piece = np.cumsum(BREAK[data])[starts] + row
    # 0 stands for no word
    return starts, ends, row, piece, np.maximum(mix(word_hashes(data, starts, ends) ^ seeds[row]), np.uint64(1))


def windows(ids: np.ndarray, piece: np.ndarray, joined: np.ndarray, words: int) -> np.ndarray:
    """For each word how many words the window that begins there has, up to ``words``. ``joined``:
    whether a word and the one after it belong in one window."""
    size = np.ones(len(ids), np.int64)
    if len(ids) > 1:
        goes = joined & (piece[1:] == piece[:-1])
        alive = np.ones(len(ids), bool)
        for k in range(min(words, len(ids)) - 1):
            step = np.zeros(len(ids), bool)
            step[:len(ids) - 1 - k] = goes[k:]
            alive &= step
            size += alive
    return size


# --- the trie -----------------------------------------------------------------------------

class Node:
    """A trie node: by the next word (8 bytes, big-endian) a further node or a container, a dict from
    the rest of the path (its words, padded with zeros to the trie's width) to its count."""
    __slots__ = ("children",)

    def __init__(self) -> None:
        self.children: dict[bytes, Node | dict] = {}


class HatTrie:
    """Counts of paths of up to ``width`` word ids. Under each first word there is a container; one with
    more than ``burst`` paths becomes a node, as long as more than one word is left to branch by."""

    def __init__(self, width: int, burst: int = BURST):
        self.width, self.burst = width, burst
        self.roots: dict[bytes, Node | dict] = {}
        self.paths: dict[bytes, int] = {}  # under each first word
        self.size = 0

    def add(self, ids: np.ndarray) -> None:
        """One for each row of ``ids`` (rows x width, 0 after the end of a path)."""
        if not len(ids):
            return
        ids = ids[np.lexsort(ids.T[::-1])]
        new = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]).any(1)))
        counts = np.diff(np.append(new, len(ids)))
        ids = ids[new]
        for at in range(0, len(ids), RUN):
            self.add_sorted(ids[at:at + RUN], counts[at:at + RUN].tolist())

    def add_sorted(self, ids: np.ndarray, counts: list[int]) -> None:
        packed = ids.astype(">u8")
        rests = packed[:, 1:].copy().view(f"V{8 * (self.width - 1)}").ravel().tolist()
        begins = np.flatnonzero(np.append(True, ids[1:, 0] != ids[:-1, 0]))
        firsts = packed[begins, :1].copy().view("V8").ravel().tolist()
        begins = begins.tolist()
        for first, low, high in zip(firsts, begins, [*begins[1:], len(rests)]):
            child, more = self.insert(self.roots.get(first, {}), rests[low:high], counts[low:high])
            self.roots[first] = child
            self.paths[first] = self.paths.get(first, 0) + more
            self.size += more

    def insert(self, child, rests: list[bytes], counts: list[int]):
        """(the child, or what it burst into; number of new paths)"""
        if isinstance(child, dict):
            before, held = len(child), child.get
            for rest, count in zip(rests, counts):
                child[rest] = held(rest, 0) + count
            more = len(child) - before
            return (self.burst_open(child) if len(child) > self.burst else child), more
        more, at = 0, 0
        while at < len(rests):  # rests come sorted, so those of one word together
            word, end = rests[at][:8], at + 1
            while end < len(rests) and rests[end][:8] == word:
                end += 1
            child.children[word], new = self.insert(child.children.get(word, {}), [r[8:] for r in rests[at:end]], counts[at:end])
            more, at = more + new, end
        return child, more

    def burst_open(self, container: dict):
        if len(next(iter(container))) <= 8:
            return container
        node = Node()
        for rest, count in container.items():
            node.children.setdefault(rest[:8], {})[rest[8:]] = count
        for word, inner in node.children.items():
            if len(inner) > self.burst:
                node.children[word] = self.burst_open(inner)
        return node

    def largest(self, share: float) -> list[bytes]:
        """First words, those with the largest subtrees, that hold ``share`` of all paths."""
        order = sorted(self.paths, key=lambda w: (-self.paths[w], w))
        held = np.cumsum([self.paths[w] for w in order])
        return order[:int(np.searchsorted(held, share * self.size)) + 1]

    def runs(self, firsts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Take subtrees out in order, those of about ``RUN`` paths at a time."""
        firsts = sorted(firsts)
        held = np.cumsum([self.paths[w] for w in firsts]) // RUN
        for low, high in pairwise([0, *(np.flatnonzero(np.diff(held)) + 1).tolist(), len(firsts)]):
            yield self.cut(firsts[low:high])

    def cut(self, firsts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Take subtrees out: their paths in order, and counts."""
        keys: list[bytes] = []
        counts: list[int] = []
        for first in sorted(firsts):
            child = self.roots.pop(first)
            self.size -= self.paths.pop(first)
            for path, container in containers(first, child):
                keys += [path + rest for rest in container]
                counts += container.values()
        ids = np.frombuffer(b"".join(keys), ">u8").astype(np.uint64).reshape(-1, self.width)
        order = np.lexsort(ids.T[::-1])
        return ids[order], np.array(counts, np.int64)[order]


def containers(path: bytes, child) -> Iterator[tuple[bytes, dict]]:
    if isinstance(child, dict):
        yield path, child
        return
    for word in child.children:
        yield from containers(path + word, child.children[word])


def node_sums(ids: np.ndarray, counts: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each depth from ``least`` words on: the trie's nodes there, and the sum of all paths that
    begin so. ``ids``: sorted paths."""
    for depth in range(least, ids.shape[1] + 1):
        deep = np.flatnonzero(ids[:, depth - 1])
        if not len(deep):
            return
        heads = ids[deep, :depth]
        new = np.flatnonzero(np.append(True, (heads[1:] != heads[:-1]).any(1)))
        yield heads[new], np.add.reduceat(counts[deep], new)


# --- counting tasks --------------------------------------------------------------------------

class Filter:
    """Bloom filter of 64-bit keys, as made by ``filter_of``."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.size = bits, len(bits) * 64

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for k in range(PROBES):
            at = probe(keys, k) & np.uint64(self.size - 1)
            found &= (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
        return found


def probe(keys: np.ndarray, k: int) -> np.ndarray:
    return keys >> np.uint64(19 * k)


def pair_keys(ids: np.ndarray) -> np.ndarray:
    """One key for each word and the next."""
    return mix(ids[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[1:])


def filter_of(keys: DataFrame, bits: int = FILTER_BITS) -> Filter:
    """Of the column ``key``. Its size is 16 bits a key, ``bits`` at most. It comes to the driver as a row of
    bytes for each ``BLOCK`` of its 64-bit words, so that the driver holds little more than the bits."""
    rows = keys.count()
    size = 1 << 10
    while size < min(16 * rows, bits):
        size *= 2
    at = F.explode(F.array(*[F.shiftrightunsigned("key", 19 * k).bitwiseAND(F.lit(size - 1)) for k in range(PROBES)]))
    cells = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("cell")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("mask"))
    blocks = cells.select(F.expr(f"cell DIV {BLOCK}").alias("block"), F.expr(f"cell % {BLOCK}").alias("at"), "mask")
    out = np.zeros(size // 64, np.uint64)
    for block, words in blocks.groupBy("block").applyInArrow(block_bytes, "block long, words binary").collect():
        part = out[block * BLOCK:(block + 1) * BLOCK]
        part[:] = np.frombuffer(words, np.uint64)[:len(part)]
    return Filter(out)


def block_bytes(cells: pa.Table) -> pa.Table:
    """One block's 64-bit words in their places, as bytes."""
    words = np.zeros(BLOCK, np.uint64)
    words[cells["at"].to_numpy()] = cells["mask"].to_numpy().view(np.uint64)
    return pa.table({"block": cells["block"].slice(0, 1), "words": pa.array([words.tobytes()], pa.binary())})


def word_counter(seed: int) -> Callable:
    """Rows of lang, id, word, f: a trie of depth one, which is a table of words."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out() -> pa.RecordBatch:
            ids = sorted(held)
            langs, words, counts = zip(*(held[i] for i in ids)) if ids else ((), (), ())
            return pa.RecordBatch.from_arrays([
                pa.array(langs, pa.string()), pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(words, pa.string()), pa.array(counts, pa.int64())],
                ["lang", "id", "word", "f"])

        for batch in batches:
            langs, seeds = row_languages(batch, seed)
            for row, data, offsets, limit in slices(batch.column("text")):
                starts, ends, rows, _, ids = slice_words(data, offsets, seeds[row:])
                if limit is not None:
                    ids = ids[starts < limit]
                known, at, counts = np.unique(ids, return_index=True, return_counts=True)
                low = LOWER[data]
                for i, k, n in zip(known.tolist(), at.tolist(), counts.tolist()):
                    if i in held:
                        held[i][2] += n
                    else:
                        held[i] = [langs[row + rows[k]], low[starts[k]:ends[k]].tobytes().decode(), n]
                if len(held) > PATHS:
                    yield out()
                    held.clear()
        yield out()
    return count


def row_languages(batch: pa.RecordBatch, seed: int) -> tuple[list, np.ndarray]:
    langs = [UNKNOWN if x is None else x for x in batch.column("lang").to_pylist()]
    of = {x: language_seed(x, seed) for x in set(langs)}
    return langs, np.array([of[x] for x in langs], np.uint64)


def phrase_counter(passed, seed: int, least: int, most: int) -> Callable:
    """Rows of path (array of word ids) and f: the trie nodes at depths from ``least`` to ``most``.
    ``passed``: broadcast (filter of words or None, filter of pairs or None)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, (words, pairs) = HatTrie(most), passed.value
        held: list[np.ndarray] = []
        waiting = 0
        for batch in batches:
            _, seeds = row_languages(batch, seed)
            for row, data, offsets, limit in slices(batch.column("text"), most):
                starts, _, _, piece, ids = slice_words(data, offsets, seeds[row:])
                if len(ids) < least:
                    continue
                if words is not None:
                    fits = words.has(ids)
                    joined = fits[1:] & fits[:-1]
                else:
                    joined = pairs.has(pair_keys(ids))
                size = windows(ids, piece, joined, most)
                if limit is not None:
                    size[starts >= limit] = 0
                held.append(window_rows(ids, size, least, most))
                waiting += len(held[-1])
                if waiting >= WAITING:
                    trie.add(np.concatenate(held))
                    held, waiting = [], 0
                    while trie.size > PATHS:
                        for run in trie.runs(trie.largest(0.5)):
                            yield from run_of(*run, least)
        if held:
            trie.add(np.concatenate(held))
        for run in trie.runs(list(trie.roots)):
            yield from run_of(*run, least)
    return count


def window_rows(ids: np.ndarray, size: np.ndarray, least: int, width: int) -> np.ndarray:
    """The windows of at least ``least`` words as rows of ids, 0 after the end."""
    at = np.flatnonzero(size >= least)
    padded, size = np.append(ids, np.zeros(width, np.uint64)), size[at]
    return np.column_stack([np.where(size > k, padded[at + k], np.uint64(0)) for k in range(width)])


def run_of(ids: np.ndarray, counts: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    """A sorted run for each depth."""
    for nodes, sums in node_sums(ids, counts, least):
        ends = pa.array(np.arange(0, nodes.size + 1, nodes.shape[1]), pa.int32())
        paths = pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(nodes).view(np.int64).ravel()))
        yield pa.RecordBatch.from_arrays([paths, pa.array(sums)], ["path", "f"])


# --- whole tables ----------------------------------------------------------------------------

def word_table(texts: DataFrame, seed: int) -> DataFrame:
    """lang, id, word, f of all words; ``clash`` marks an id that two words have."""
    counted = texts.mapInArrow(word_counter(seed), "lang string, id long, word string, f long")
    by_word = counted.groupBy("lang", "id").agg(F.sum("f").alias("f"), F.min("word").alias("word"), F.max("word").alias("last"))
    return by_word.select("lang", "id", "word", "f", (F.col("word") != F.col("last")).alias("clash"))


def distinct_word_table(texts: DataFrame) -> tuple[DataFrame, int]:
    """The stored table of words and the seed with which every word has an id of its own."""
    for seed in range(8):
        words = durable(word_table(texts, seed), "words")
        clash = words.agg(F.max(F.col("clash")).alias("inside"), (F.count("*") - F.count_distinct("id")).alias("between")).first()
        if not clash["inside"] and not clash["between"]:
            return words.drop("clash"), seed
    raise RuntimeError("words share ids under every seed")


def frequent_phrases(docs: DataFrame, least: int = 100, most: int = MOST_WORDS) -> tuple[DataFrame, DataFrame]:
    """Stored tables: all words (lang, id, word, f), and the phrases of 2 to ``most`` words that occur
    ``least`` times or more (path: array of word ids, f)."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    words, seed = distinct_word_table(texts)

    def counted(filters: tuple, shortest: int, longest: int) -> DataFrame:
        runs = texts.mapInArrow(phrase_counter(spark.sparkContext.broadcast(filters), seed, shortest, longest), "path array<long>, f long")
        return runs.groupBy("path").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)

    frequent = filter_of(words.filter(F.col("f") >= least).select(F.col("id").alias("key")))
    pairs = durable(counted((frequent, None), 2, 2), "pairs")
    if most == 2:
        return words, pairs
    packed = pairs.select("path").mapInArrow(pair_key_rows, "key long")
    longer = durable(counted((None, filter_of(packed)), 3, most), "phrases")
    return words, pairs.unionByName(longer)


def pair_key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("path").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 2)
        keys = mix(ids[:, 0] * np.uint64(0x9E3779B97F4A7C15) + ids[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])


def scored(words: DataFrame, phrases: DataFrame, of: DataFrame) -> DataFrame:
    """lang, path, a, l, r, n, score: every phrase in ``of`` with its lowest-scoring cut (ties: the
    shortest first part). Products are decimals of 38 digits."""
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    parts = phrases.select("path", "f").unionByName(words.select(F.array("id").alias("path"), "f"))
    cuts = of.select("path", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("k"))
    cuts = cuts.select("path", "a", "k", F.expr("slice(path, 1, k)").alias("head"), F.expr("slice(path, k + 1, size(path) - k)").alias("tail"))
    cuts = cuts.join(parts.select(F.col("path").alias("head"), F.col("f").alias("l")), "head")
    cuts = cuts.join(parts.select(F.col("path").alias("tail"), F.col("f").alias("r")), "tail")
    languages = words.select(F.col("id").alias("first"), "lang")
    cuts = cuts.withColumn("first", F.get("path", F.lit(0))).join(languages, "first").join(totals, "lang")
    score = F.expr("CAST(1000 * CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(15,0)) AS DECIMAL(38,0)) "
                   "DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    cuts = cuts.withColumn("score", score.cast("long"))
    low = cuts.groupBy("lang", "path", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return low.select("lang", "path", "a", "cut.l", "cut.r", "n", "cut.score")


def not_inside_longer(phrases: DataFrame) -> DataFrame:
    """Phrases that no longer one always surrounds. A longer phrase never occurs more often than
    one inside it, so as often means always; and if some longer phrase does, so does the one of
    a word more, which is the only one to look at."""
    inner = phrases.filter(F.size("path") > 2).select("f", F.explode(F.array(
        F.expr("slice(path, 1, size(path) - 1)"), F.expr("slice(path, 2, size(path) - 1)"))).alias("path")).distinct()
    return phrases.join(inner, ["path", "f"], "left_anti")


def collocations(docs: DataFrame, least: int = 100, most: int = MOST_WORDS, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of ``docs`` (text, lang)."""
    words, phrases = frequent_phrases(docs, least, most)
    judged = durable(scored(words, phrases, not_inside_longer(phrases)), "scored")
    return ranked(named(judged, words), top)


def named(judged: DataFrame, words: DataFrame) -> DataFrame:
    """With ``phrase``: the words of the path, joined by spaces."""
    places = judged.select("path", F.posexplode("path").alias("at", "id")).join(words.select("id", "word"), "id")
    texts = places.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"))
    return judged.join(texts.select("path", F.array_join("w.word", " ").alias("phrase")), "path")


def ranked(judged: DataFrame, top: int) -> DataFrame:
    order: Column = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = judged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
