"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

One inserted, deleted or replaced code point moves a word's vector of letter counts by an L1
distance of at most two: one for an insertion, two for a replacement. So the near words of a
word lie in a small ball around its vector, among words of its own length (radius two) and of
one letter less (radius one); each pair of lengths is searched by itself.

Words of one length are the points of a k-d tree. Its top is cut by medians of a bounded sample
of words and deals all words to cells, a Spark group each; a word asks every cell that its ball
touches, with the cell's box as bound. A cell with more than ``CELL`` words (words of one vector
cannot be cut apart) is dealt into blocks by a hash, each of which is asked. Inside a group the tree
goes on down to leaves of ``LEAF`` points; a node's box prunes all queries too far from it at
once, and what remains in a leaf is verified by letter order: one replaced code point, or equal
beginnings and ends around one inserted. A pair meets in exactly one group. The sample and the
caps set how the work is cut, never what is found.

Groups return, for each of their words, the number of near words and the most frequent one, so
nothing grows with the number of pairs. ``variant_forms`` links each word to its most frequent
near word, if that is ``ratio`` times as frequent, and follows the links to their end by doubling.

Words are any strings (code points count, case does); null words take no part, repeated rows of
a word add up. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.session import durable, ship_package

#: a-z have a place each; other code points share the places after them
LETTERS, OTHERS = 26, 14
SAMPLE = 65_536
CELL = 32_768
LEAF = 48
#: numbers compared at once in a leaf
CHUNK = 1 << 22
NEAR = "word string, n_near long, most long, form string"


# --- vectors ------------------------------------------------------------------------------

def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words of one length as a matrix (an empty one: no columns)."""
    width = len(words[0]) if words else 0
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat.reshape(len(words), width), letter_counts(flat.reshape(len(words), width))


def letter_counts(points: np.ndarray) -> np.ndarray:
    place = points.astype(np.int64)
    letter = (place >= 97) & (place <= 122)
    place = np.where(letter, place - 97, LETTERS + place % OTHERS)
    width = LETTERS + OTHERS
    cells = (np.arange(len(points))[:, None] * width + place).ravel()
    return np.bincount(cells, minlength=len(points) * width).reshape(-1, width).astype(np.int16)


# --- the top of the tree -----------------------------------------------------------------

@dataclass
class Cut:
    """A plane: counts of ``place`` up to ``at`` go left. Leaves have a cell number."""
    place: int = -1
    at: int = 0
    left: "Cut | None" = None
    right: "Cut | None" = None
    cell: int = 0


@dataclass
class Cells:
    """Planes by word length, and how many cells each has."""
    roots: dict[int, Cut] = field(default_factory=dict)

    def home(self, length: int, counts: np.ndarray) -> np.ndarray:
        """The cell that each word lies in."""
        out = np.zeros(len(counts), np.int32)
        stack = [(self.roots.get(length, Cut()), np.arange(len(counts)))]
        while stack:
            cut, rows = stack.pop()
            if cut.left is None:
                out[rows] = cut.cell
            else:
                low = counts[rows, cut.place] <= cut.at
                stack += [(cut.left, rows[low]), (cut.right, rows[~low])]
        return out

    def touched(self, length: int, counts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, cell) for every cell of ``length`` whose box is within ``radius``. The box of a cell
        is what its planes bound; the way to it is added up place by place."""
        width = counts.shape[1]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        stack = [(self.roots.get(length, Cut()), np.arange(len(counts)), np.zeros((len(counts), width), np.int16))]
        while stack:
            cut, rows, away = stack.pop()
            if not len(rows):
                continue
            if cut.left is None:
                found.append((rows, np.full(len(rows), cut.cell, np.int32)))
                continue
            here = counts[rows, cut.place].astype(np.int16)
            for child, beyond in ((cut.left, here - cut.at), (cut.right, cut.at + 1 - here)):
                moved = away.copy()
                moved[:, cut.place] = np.maximum(moved[:, cut.place], np.maximum(beyond, 0))
                near = moved.sum(1) <= radius
                stack.append((child, rows[near], moved[near]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        return np.concatenate([r for r, _ in found]), np.concatenate([c for _, c in found])


def best_plane(counts: np.ndarray) -> tuple[int, int] | None:
    """The place and count that cut the words most evenly; None if all have one vector."""
    best, place, at = 0, -1, 0
    for p in range(counts.shape[1]):
        below = np.cumsum(np.bincount(counts[:, p]))
        even = np.minimum(below, len(counts) - below)
        k = int(even.argmax())
        if even[k] > best:
            best, place, at = int(even[k]), p, k
    return (place, at) if best else None


def cut_cells(samples: dict[int, list[str]], share: float, cell: int = CELL) -> Cells:
    """Planes from sampled words by length; ``share``: of all words that were sampled."""
    cells = Cells()
    for length, words in samples.items():
        number = 0

        def grow(counts: np.ndarray) -> Cut:
            nonlocal number
            # a part of fewer than 16 sampled words says too little about where to cut
            plane = best_plane(counts) if len(counts) > max(share * cell, 16) else None
            if plane is None:
                number += 1
                return Cut(cell=number - 1)
            low = counts[:, plane[0]] <= plane[1]
            return Cut(*plane, grow(counts[low]), grow(counts[~low]))

        cells.roots[length] = grow(code_points(words)[1])
    return cells


# --- inside a cell --------------------------------------------------------------------------

def tree_pairs(points: np.ndarray, queries: np.ndarray, radius: int, leaf: int = LEAF) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, point) of all pairs of count vectors within ``radius``, in parts. A k-d tree is walked
    with all queries at once: at each node those go on that its box is near enough to."""
    # a row for each place: sums over places then run along queries; twice the letters of a word must fit
    most = max((int(counts.sum(1, dtype=np.int64).max()) for counts in (points, queries) if len(counts)), default=0)
    kind = np.int16 if 2 * most <= np.iinfo(np.int16).max else np.int64
    points, places = points.astype(kind), np.ascontiguousarray(queries.T, kind)
    stack = [(np.arange(len(points)), np.arange(len(queries)))]
    while stack:
        mine, asked = stack.pop()
        if not len(mine) or not len(asked):
            continue
        inside = points[mine]
        low, high = inside.min(0)[:, None], inside.max(0)[:, None]
        q = places.take(asked, 1)
        beyond = np.maximum(low - q, q - high)
        asked = asked[np.maximum(beyond, 0, out=beyond).sum(0, dtype=kind) <= radius]
        if not len(asked):
            continue
        plane = best_plane(inside) if len(mine) > leaf else None
        if plane is not None:
            goes = inside[:, plane[0]] <= plane[1]
            stack += [(mine[goes], asked), (mine[~goes], asked)]
            continue
        step = max(1, CHUNK // len(mine))
        for a in range(0, len(asked), step):
            part = asked[a:a + step]
            far = np.zeros((len(mine), len(part)), kind)
            apart = np.empty_like(far)
            for mine_there, asked_there in zip(inside.T, places.take(part, 1)):
                np.subtract(asked_there, mine_there[:, None], out=apart)
                far += np.abs(apart, out=apart)
            i, j = np.nonzero(far <= radius)
            yield part[j], mine[i]


def one_edit(longer: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Whether rows of code points differ by exactly one replacement, or by one letter more."""
    if longer.shape[1] == shorter.shape[1]:
        return (longer != shorter).sum(1) == 1
    width = shorter.shape[1]
    if not width:
        return np.ones(len(longer), bool)
    front = np.logical_and.accumulate(longer[:, :-1] == shorter, axis=1).sum(1)
    back = np.logical_and.accumulate((longer[:, 1:] == shorter)[:, ::-1], axis=1).sum(1)
    return front + back >= width


class Nearest:
    """Of each word the number of near words and the most frequent (ties: first by code points)."""

    def __init__(self, words: list[str], n: np.ndarray):
        self.words, self.n = words, n
        order = sorted(range(len(words)), key=lambda i: (-int(n[i]), words[i]))
        self.rank = np.empty(len(words), np.int64)
        self.rank[order] = np.arange(len(words))
        self.order = np.array(order, np.int64)
        self.near = np.zeros(len(words), np.int64)
        self.best = np.full(len(words), len(words), np.int64)

    def add(self, word: np.ndarray, other: np.ndarray) -> None:
        np.add.at(self.near, word, 1)
        np.minimum.at(self.best, word, self.rank[other])

    def rows(self) -> pa.Table:
        has = np.flatnonzero(self.near)
        form = self.order[self.best[has]]
        return pa.table({"word": pa.array([self.words[i] for i in has], pa.string()), "n_near": self.near[has],
                         "most": self.n[form], "form": pa.array([self.words[i] for i in form], pa.string())})


def compare_cell(points: pa.Table, queries: pa.Table) -> pa.Table:
    """Near words within one cell: ``points`` and ``queries`` have word, n; a query is of the points'
    length or one letter longer."""
    words = points.column("word").to_pylist() + queries.column("word").to_pylist()
    found = Nearest(words, np.concatenate([points.column("n").to_numpy(), queries.column("n").to_numpy()]).astype(np.int64))
    if not len(points) or not len(queries):
        return found.rows()
    letters, counts = code_points(words[:len(points)])
    lengths = np.array([len(w) for w in words[len(points):]])
    for longer in (False, True):
        rows = np.flatnonzero(lengths == letters.shape[1] + longer)
        if not len(rows):
            continue
        asked, asked_counts = code_points([words[len(points) + i] for i in rows])
        for q, p in tree_pairs(counts, asked_counts, 1 if longer else 2):
            near = one_edit(asked[q], letters[p])
            q, p = q[near], p[near]
            found.add(rows[q] + len(points), p)
            if longer:  # words of one length ask each other
                found.add(p, rows[q] + len(points))
    return found.rows()


# --- whole tables -----------------------------------------------------------------------------

def sampled(words: DataFrame, rows: int) -> tuple[dict[int, list[str]], float]:
    """At most ``rows`` words, those with the smallest hash, by length; and their share of all."""
    total = words.count()
    found: dict[int, list[str]] = {}
    for row in words.select("word").orderBy(F.xxhash64("word"), "word").limit(rows).toLocalIterator():
        found.setdefault(len(row["word"]), []).append(row["word"])
    return found, min(1.0, rows / total) if total else 1.0


def placer(cells, asking: bool) -> Callable:
    """Rows of word, n, length, cell: the home of each word, or every cell it asks."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = cells.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1 << 14):
                part = batch.slice(start, 1 << 14)
                words, n = part.column("word").to_pylist(), part.column("n").to_numpy()
                lengths = np.array([len(w) for w in words])
                for length in np.unique(lengths).tolist():
                    rows = np.flatnonzero(lengths == length)
                    counts = code_points([words[i] for i in rows])[1]
                    if asking:
                        answers = [(length, *planes.touched(length, counts, 2)), (length - 1, *planes.touched(length - 1, counts, 1))]
                    else:
                        answers = [(length, np.arange(len(rows)), planes.home(length, counts))]
                    for of, word, cell in answers:
                        yield pa.RecordBatch.from_arrays([
                            pa.array([words[i] for i in rows[word]], pa.string()), pa.array(n[rows[word]]),
                            pa.array(np.full(len(word), of, np.int32)), pa.array(cell.astype(np.int32))], ["word", "n", "length", "cell"])
    return place


def near_words(counted: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """word, n_near, most, form (the near word of largest count, and that count) of the words of
    ``counted`` (word, n; each word once, stored) that have near ones."""
    spark = counted.sparkSession
    ship_package(spark)
    planes = spark.sparkContext.broadcast(cut_cells(*sampled(counted, sample), cell))
    placed = "word string, n long, length int, cell int"
    homes = durable(counted.mapInArrow(placer(planes, False), placed), "homes")
    blocks = homes.groupBy("length", "cell").agg(F.ceil(F.count("*") / cell).cast("int").alias("blocks"))
    blocks = F.broadcast(durable(blocks, "cells"))  # at most a cell for every 8 words of the sample
    points = homes.join(blocks, ["length", "cell"]).select(
        "word", "n", "length", "cell", F.pmod(F.xxhash64("word", F.lit(5)), "blocks").cast("int").alias("block"))
    asked = counted.mapInArrow(placer(planes, True), placed).join(blocks, ["length", "cell"]).select(
        "word", "n", "length", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    keys = ["length", "cell", "block"]
    found = points.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(compare_cell, NEAR)
    best = F.min(F.struct((-F.col("most")).alias("rest"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.rest")).alias("most"), F.col("best.form").alias("form"))


def variant_forms(words: DataFrame, ratio: int = 2, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``words`` (word, n)."""
    counted = words.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    counted = durable(counted, "words")
    near = near_words(counted, sample, cell)
    linked = F.col("most") >= ratio * F.col("n")
    forms = durable(counted.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(linked, F.col("form")).alias("form"), F.when(linked, F.col("most")).alias("form_n")), "forms")
    roots = follow(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return forms.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def follow(links: DataFrame) -> DataFrame:
    """word, root: each link's end. Counts rise along links, so they end; every round joins the
    links with themselves and doubles the way they go."""
    current = durable(links, "roots")
    while True:
        beyond = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = current.join(beyond, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = durable(moved, "roots")
        if moved.filter("moved").isEmpty():
            return moved.select("word", "root")
        current = moved.select("word", "root")


def word_counts(texts: DataFrame, pattern: str, changed=None) -> DataFrame:
    """word, n: maximal runs of ``pattern`` in the column text, A-Z lower-cased. ``changed``: what
    becomes of a run (column ``run``) before it is counted, by default nothing. One explode and
    one aggregate that folds within each task first."""
    runs = texts.select(*[c for c in texts.columns if c != "text"], F.explode(F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1))).alias("run"))
    # translate looks every character up; a run of ASCII alone is lower-cased as bytes
    ascii = F.octet_length("run") == F.char_length("run")
    runs = runs.withColumn("run", F.when(ascii, F.lower("run")).otherwise(F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return runs.select((changed if changed is not None else F.col("run")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
