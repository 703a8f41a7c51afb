"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the UTF-8 buffers of whole texts, many documents per numpy operation. Trees
are grown level by level on binned statistics and kept as flat arrays (feature, threshold, leaf
value; the children of node i are 2 i + 1 and 2 i + 2), so that scoring a batch is a few array
operations per tree and level.

The model is fitted on the driver from at most ``TRAIN_ROWS`` labelled documents, those with the
smallest hash of their id; only their texts are read for it. Every other step covers all rows.

Null texts are empty ones; an empty text has all statistics 0 and gets the score of those. Labels
that are null are left out, contradicting labels of one id are averaged, null ids are scored but
never learned from. Without labels of both classes every score is the share of label 1 (0.5
without labels). Repeated rows get equal scores. Other columns are passed through; one named like
the result is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaestor.llm.words import distinct_by_row, shingle_hashes, text_slices, word_bounds, word_hashes
from quaestor.session import ship_package

TRAIN_ROWS = 20_000
BINS = 64
#: bytes of text measured at once; some twenty numbers of 8 bytes are held for each
SLICE = 1 << 18

_BYTE = np.arange(256)
UPPER = (_BYTE >= 65) & (_BYTE <= 90)
LETTER = UPPER | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
STOP = np.isin(_BYTE, [ord(c) for c in ".,;:!?"])
OTHER = ~(LETTER | DIGIT | STOP) & (_BYTE > 32)

STATISTICS = [
    "log_bytes", "log_words", "word_length", "word_length_deviation", "capitals", "digits", "stops", "others", "exclamations",
    "line_breaks", "distinct_words", "same_as_before", "commonest_word", "words_without_letters", "capital_words", "short_words",
    "ends_in_stop", "ends_in_other", "repeated_lines", "words_per_line", "distinct_triples", "words_seen_again", "spaces", "line_of_others", "line_of_capitals",
]


def by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums over each document's part."""
    sums = np.zeros(len(values) + 1)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def largest(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.maximum.reduceat(values, offsets[:-1][full])
    return out


def sorted_counts(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each distinct value occurs in its document, and offsets of those."""
    values = values.copy()
    for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        values[low:high].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[offsets[:-1][np.diff(offsets) > 0]] = True
    at = np.flatnonzero(new)
    return np.diff(np.append(at, len(values))), np.searchsorted(at, offsets)


def slice_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    starts, ends, words_at = word_bounds(data, offsets)
    n_bytes, n_words = np.diff(offsets), np.diff(words_at)
    hashes = word_hashes(data, starts, ends)
    length = (ends - starts).astype(float)
    per_byte, per_word = 1 / np.maximum(n_bytes, 1), 1 / np.maximum(n_words, 1)

    def share(table: np.ndarray) -> np.ndarray:
        return by_row(table[data], offsets) * per_byte

    def words_with(mask: np.ndarray) -> np.ndarray:
        return by_row(mask, words_at) * per_word

    letters, capitals = LETTER[data], UPPER[data]
    letter_sums, capital_sums = np.append(0, np.cumsum(letters)), np.append(0, np.cumsum(capitals))
    word_letters = letter_sums[ends] - letter_sums[starts]
    word_capitals = capital_sums[ends] - capital_sums[starts]
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[words_at[:-1][n_words > 0]] = False
    counts, kinds_at = sorted_counts(hashes, words_at)
    triples, triples_at = shingle_hashes(hashes, words_at, 3)
    _, triple_kinds_at = distinct_by_row(triples, triples_at)

    # lines as the words between two line breaks, hashed by sums of place-weighted word hashes
    breaks = np.append(0, np.cumsum(data == 10))
    line = breaks[starts]
    new_line = np.ones(len(line), bool)
    new_line[1:] = line[1:] != line[:-1]
    new_line[words_at[:-1][n_words > 0]] = True
    line_at = np.flatnonzero(new_line)
    lines_at = np.searchsorted(line_at, words_at)
    place = np.arange(len(hashes)) - np.repeat(line_at, np.diff(np.append(line_at, len(hashes))))
    line_hash = np.add.reduceat(hashes * (2 * place.astype(np.uint64) + np.uint64(1)), line_at) if len(line_at) else hashes
    n_lines = np.diff(lines_at)
    _, line_kinds_at = sorted_counts(line_hash, lines_at)

    def worst_line(mask: np.ndarray) -> np.ndarray:
        per_line = np.add.reduceat(mask.astype(float), line_at) / np.diff(np.append(line_at, len(mask))) if len(line_at) else np.zeros(0)
        return largest(per_line, lines_at)

    odd, loud = OTHER[last] | (word_letters == 0), (word_capitals >= 2) & (word_capitals == word_letters)
    mean = by_row(length, words_at) * per_word
    return np.column_stack([
        np.log1p(n_bytes), np.log1p(n_words), mean, np.sqrt(np.maximum(by_row(length**2, words_at) * per_word - mean**2, 0)),
        by_row(capitals, offsets) / np.maximum(by_row(letters, offsets), 1), share(DIGIT), share(STOP), share(OTHER),
        by_row(data == 33, offsets) * per_word, by_row(data == 10, offsets) * per_word,
        np.diff(kinds_at) * per_word, words_with(same), largest(counts, kinds_at) * per_word,
        words_with(word_letters == 0), words_with(loud), words_with(length <= 3),
        words_with(STOP[last]), words_with(OTHER[last]),
        1 - np.diff(line_kinds_at) / np.maximum(n_lines, 1) * (n_lines > 0) - (n_lines == 0), n_words / np.maximum(n_lines, 1),
        np.diff(triple_kinds_at) / np.maximum(np.diff(triples_at), 1), by_row(np.where(counts > 1, counts, 0), kinds_at) * per_word,
        share(_BYTE <= 32), worst_line(odd), worst_line(loud),
    ])


def column_statistics(texts: pa.Array) -> np.ndarray:
    parts = [slice_statistics(data, offsets) for _, data, offsets in text_slices(texts, SLICE)]
    return np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))


@dataclass
class BoostedTrees:
    start: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes: above goes right
    value: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 5, rate: float = 0.15, ridge: float = 1.0, least: float = 5.0) -> BoostedTrees:
    """``y``: 0 to 1. ``least``: the smallest sum of second derivatives in a child."""
    inner = 2**depth - 1
    mean = float(y.mean()) if len(y) else 0.5
    start = float(np.log(mean / (1 - mean))) if 0 < mean < 1 else (20.0 if mean >= 1 else -20.0)
    empty = BoostedTrees(start, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if not len(y) or not 0 < mean < 1:
        return empty
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(width)]
    binned = np.column_stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)])
    cells = binned + np.arange(width) * BINS
    total = np.full(n, start)
    grown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        slope, curve = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            where = ((node - first)[:, None] * (width * BINS) + cells).ravel()
            g = np.bincount(where, np.repeat(slope, width), many * width * BINS).reshape(many, width, BINS)
            h = np.bincount(where, np.repeat(curve, width), many * width * BINS).reshape(many, width, BINS)
            gl, hl = g.cumsum(2), h.cumsum(2)
            g_all, h_all = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (g_all - gl)**2 / (h_all - hl + ridge) - g_all**2 / (h_all + ridge)
            gain = np.where((hl >= least) & (h_all - hl >= least), gain, 0).reshape(many, -1)
            best = gain.argmax(1)
            split = gain[np.arange(many), best] > 1e-9
            f, b = best // BINS, best % BINS
            for k in np.flatnonzero(split):
                feature[first + k], threshold[first + k] = f[k], edges[f[k]][b[k]]
            goes = split[node - first] & (binned[np.arange(n), f[node - first]] > b[node - first])
            node = 2 * node + 1 + goes
        g, h = np.bincount(node - inner, slope, inner + 1), np.bincount(node - inner, curve, inner + 1)
        value = -rate * g / (h + ridge)
        total += value[node - inner]
        grown.append((feature, threshold, value))
    return BoostedTrees(start, *(np.array(part) for part in zip(*grown)))


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``rows`` documents. ``learn``: condition on doc_id."""
    ship_package(docs.sparkSession)
    chosen = (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.avg("quality").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", F.coalesce("text", F.lit("")).alias("text"), "doc_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = column_statistics(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), lists], ["doc_id", "label", "x"])

    measured = known.mapInArrow(measure, T.StructType([known.schema["doc_id"], known.schema["label"], T.StructField("x", T.ArrayType(T.DoubleType()))]))
    # of rows that share an id one is learned from
    found = measured.groupBy("doc_id").agg(F.min("x").alias("x"), F.min("label").alias("label")).orderBy("doc_id").select("x", "label").toPandas()
    if found.empty:
        return np.zeros((0, len(STATISTICS))), np.zeros(0)
    return np.array(found["x"].tolist()), found["label"].to_numpy(float)


def scorer(model: BoostedTrees, text: str, schema: list[str]) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(column_statistics(batch.column(text)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in schema] + [pa.array(scores)], [*schema, "score"])
    return score


def quality_scores(docs: DataFrame, model: BoostedTrees, text: str = "text") -> DataFrame:
    """``docs`` with ``score``: 0 to 1, higher where label 1 is likelier."""
    ship_package(docs.sparkSession)
    keep = [f for f in docs.schema.fields if f.name != "score"]
    names = [f.name for f in keep]
    return docs.select(*names).mapInArrow(scorer(model, text, names), T.StructType([*keep, T.StructField("score", T.DoubleType())]))


def quality_model(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = TRAIN_ROWS) -> BoostedTrees:
    return fit(*training_rows(docs, labels, learn, rows))
