"""Packing tokenized documents into sequences of bounded length by bin completion.

Documents are tokenized, ended with one id, and only those longer than a sequence are cut. Full
pieces are sequences of their own. The others are dealt evenly into groups of about
``GROUP_SEQUENCES`` sequences, each solved in one task whose size that bounds:

* Best-fit decreasing gives the first incumbent. If it needs no more sequences than the lower
  bound (total length, or pieces above half a sequence), it is optimal.
* Else a depth-first search fills one sequence at a time around the largest document left. It
  enumerates the undominated fillings of the rest, of any number of documents - a filling is dominated
  if one document that also fits is at least as long as some of its documents together - by least waste
  first, from the sums that the lengths left can make, and gives up a branch once its waste exceeds
  what a better solution may waste. ``NODES`` and ``TESTS`` bound the search; the best so far
  then stands, so a packing is always whole.

Null texts are empty: one piece of the end id alone. Null and repeated ids are rows like any other.
An empty table gives no pieces.
"""

from __future__ import annotations

import itertools
import json
import os
import struct
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaestor.llm.words import LOWER, SPACE, text_slices
from quaestor.session import ship_package

GROUP_SEQUENCES = 2048
NODES = 20_000
#: fillings of one group that are tested for dominance
TESTS = 200_000
#: sequences whose fillings are kept at hand; those of earlier ones are found anew
OPEN_LEVELS = 16
CACHE_WORDS = 300_000
PIECES = "doc_id long, piece int, start long, length long, ids binary"
LETTER = np.isin(np.arange(256), [c + d for c in b"Aa" for d in range(26)])
#: the two bytes of a letter from U+00C0 on that lower-casing leaves a letter alone, below ``BEYOND_LATIN_BYTE``
LATIN = np.zeros(1 << 16, bool)
LATIN[[int.from_bytes(chr(c).encode(), "big") for c in range(0xC0, 0x240) if chr(c).isalpha() and c != 0x130]] = True
#: ASCII characters that are neither letters nor white space
OTHER = ~LETTER & ~SPACE & (np.arange(256) < 128)

_loaded: dict[int, "WordTokenizer"] = {}


class WordTokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit numbers, for a tokenizer that composes
    and lower-cases, drops white space, parts letters from other characters and never joins what
    it has parted. So texts are cut at white space and behind letters that another ASCII character
    follows, on the UTF-8 bytes of many texts at a time; each distinct part is encoded once and kept,
    and the ids of the texts are gathered from those of their parts. The table is emptied when it
    holds ``CACHE_WORDS``."""

    #: a capital with a two-character small form; from BEYOND_LATIN on nothing is assumed
    UNLIKE, BEYOND_LATIN = "\u0130", "\u0250"
    #: UTF-8 bytes from here on begin characters from U+0240 on, combining ones among them
    BEYOND_LATIN_BYTE = 0xC9

    def __init__(self, description: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(description)
        parts = json.loads(description)
        self.added = [token["content"].encode().lower() for token in parts["added_tokens"]]
        parts["normalizer"] = None
        parts["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, parts["pre_tokenizer"]["pretokenizers"][-1]]}
        self.of_letters = Tokenizer.from_str(json.dumps(parts))
        suffix = parts["model"]["end_of_word_suffix"]
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}

    @staticmethod
    def encode(tokenizer, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e)}I", *e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_stems(self, stems: list[str]) -> Iterator[bytes]:
        """Many at a time; the ids tell where each ends."""
        joined = [" ".join(stems[k:k + 256]) for k in range(0, len(stems), 256)]
        for encoding in self.of_letters.encode_batch_fast(joined, add_special_tokens=False):
            ids = np.array(encoding.ids, "<u4")
            packed, start = ids.tobytes(), 0
            for end in (4 * np.flatnonzero(self.ends_word[ids]) + 4).tolist():
                yield packed[start:end]
                start = end

    def learn(self, words: list[str]) -> None:
        letters, others = [], []
        for word in words:
            latin = word.isalpha() and (word.isascii() or max(word) < self.BEYOND_LATIN and self.UNLIKE not in word)
            (letters if latin else others).append(word)
        self.known.update(zip(letters, self.encode_stems([word.lower() for word in letters]), strict=True))
        self.known.update(zip(others, self.encode(self.tokenizer, others)))

    def parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """All parts of consecutive texts, in order, and offsets of each text's among them. In texts of
        Latin letters A-Z are lower-cased; those with a token that was added to the vocabulary, in either
        case, are cut at white space only and left as they are."""
        sizes = np.diff(offsets)
        full = np.flatnonzero(sizes)
        highest = np.zeros(len(sizes), np.uint8)
        highest[full] = np.maximum.reduceat(data, offsets[:-1][full]) if len(full) else 0
        lowered = LOWER[data]
        free, flat = np.ones(len(sizes), bool), lowered.tobytes()
        for token in self.added:
            at = flat.find(token)
            while at >= 0:
                free[np.searchsorted(offsets, at, side="right") - 1] = False
                at = flat.find(token, at + 1)
        plain = free & (highest < self.BEYOND_LATIN_BYTE)
        data = lowered if plain.all() else np.where(np.repeat(plain, sizes), lowered, data)
        inside = ~SPACE[data]
        letter = LETTER[data[:-1]]
        letter[1:] |= LATIN[(data[:-2].astype(np.uint16) << 8) | data[1:-1]]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | (letter & OTHER[data[1:]])
        if not free.all():
            begins[1:] &= ~inside[:-1] | np.repeat(free, sizes)[1:]
        heads = offsets[:-1][full]
        begins[heads] = inside[heads]
        joined = data[inside]
        starts = np.append(np.flatnonzero(begins[inside]), len(joined)).astype(np.int32)
        parts = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(joined))
        return parts, np.searchsorted(np.flatnonzero(begins), offsets)

    def slice_ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive texts and offsets of each text's among them."""
        parts, by_text = self.parts(data, offsets)
        coded = parts.dictionary_encode()
        words, places = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        self.learn([w for w in words if w not in known])
        packed = [known[w] for w in words]
        ids, sizes = np.frombuffer(b"".join(packed), "<u4"), np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        first, sizes = (np.cumsum(sizes) - sizes)[places], sizes[places]
        ends = np.append(0, np.cumsum(sizes))
        return ids[np.arange(ends[-1]) + np.repeat(first - ends[:-1], sizes)], ends[by_text]

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        for _, data, offsets in text_slices(pa.array(texts, pa.large_string())):
            ids, ends = self.slice_ids(data, offsets)
            packed = ids.tobytes()
            yield from (packed[4 * low:4 * high] for low, high in itertools.pairwise(ends.tolist()))


def piece_maker(description, room: int, end_id: int) -> Callable:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(description.value)
        if key not in _loaded:
            _loaded[key] = WordTokenizer(description.value)
        tokenizer = _loaded[key]
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = batch.column("doc_id")
            for first, data, offsets in text_slices(batch.column("text")):
                all_ids, ends = tokenizer.slice_ids(data, offsets)
                all_ids = all_ids.tobytes()
                rows, piece, start, parts = [], [], [], []
                for row, (low, high) in enumerate(itertools.pairwise(ends.tolist()), first):
                    packed = all_ids[4 * low:4 * high] + end
                    for k, at in enumerate(range(0, len(packed), 4 * room)):
                        rows.append(row)
                        piece.append(k)
                        start.append(at // 4)
                        parts.append(packed[at:at + 4 * room])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array([len(p) // 4 for p in parts], pa.int64()), pa.array(parts, pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids"])
    return make


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, room: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit) for all of ``docs``.
    The tokenizer's file is read on the driver and sent to the tasks; it has a few MB."""
    spark = docs.sparkSession
    ship_package(spark)
    with open(tokenizer_path, encoding="utf-8") as file:
        description = spark.sparkContext.broadcast(file.read())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        piece_maker(description, room, end_id), PIECES)


def best_fit_decreasing(lengths: list[int], room: int) -> list[list[int]]:
    """Fillings (lengths) by best fit; ``lengths`` descending. Sequences are kept by what they
    have left, so that the tightest that fits is the next number with one."""
    fillings: list[list[int]] = []
    by_left: dict[int, list[int]] = defaultdict(list)
    open_left = 0  # bit r: a sequence has r left
    for n in lengths:
        fitting = open_left >> n
        if fitting:
            left = n + (fitting & -fitting).bit_length() - 1
            at = by_left[left].pop()
            if not by_left[left]:
                open_left &= ~(1 << left)
        else:
            left, at = room, len(fillings)
            fillings.append([])
        fillings[at].append(n)
        if left > n:
            by_left[left - n].append(at)
            open_left |= 1 << (left - n)
    return fillings


class Completion:
    """Bin completion over a multiset of lengths."""

    def __init__(self, lengths: list[int], room: int):
        self.room = room
        self.counts = [0] * (room + 1)
        for n in lengths:
            self.counts[n] += 1
        self.present = sum(1 << n for n in set(lengths))
        self.total = sum(lengths)
        self.bound = max(-(-self.total // room), sum(2 * n > room for n in lengths))
        self.nodes = self.tests = 0

    def take(self, filling: list[int]) -> None:
        for n in filling:
            self.counts[n] -= 1
            if not self.counts[n]:
                self.present &= ~(1 << n)

    def give_back(self, filling: list[int]) -> None:
        for n in filling:
            self.counts[n] += 1
            self.present |= 1 << n

    def longest(self, most: int) -> int:
        """The longest document left of at most ``most``; 0 if none."""
        found = (self.present & ((2 << most) - 1)).bit_length() - 1
        return max(found, 0)

    def reachable(self, left: int) -> tuple[list[int], list[int], list[int]]:
        """The lengths left of at most ``left``, ascending, how many of each may go in, and for
        each the sums (as bits) that those before it can make; all sums come last."""
        lengths, most, sums = [], [], [1]
        mask = (2 << left) - 1
        rest = self.present & mask & ~1
        while rest:
            n = (rest & -rest).bit_length() - 1
            rest &= rest - 1
            lengths.append(n)
            most.append(min(self.counts[n], left // n))
            made, copies, step = sums[-1], most[-1], 1
            if made != mask:
                while copies:
                    step = min(step, copies)
                    made |= made << (n * step)
                    copies -= step
                    step *= 2
                made &= mask
            sums.append(made)
        return lengths, most, sums

    def dominated(self, filling: list[int], waste: int) -> bool:
        """Whether one document that is left beside ``filling`` is at least as long as some of
        its documents together (longer than one, as long as several) and fits instead of them."""
        single, several = 0, 0
        for n in filling:
            several |= several << n | single << n
            single |= 1 << n
        longer, width = (single | 1) << 1, 1  # sums + 1 .. sums + waste
        if not waste:
            longer = 0
        while width < waste:
            step = min(width, waste - width)
            longer |= longer << step
            width += step
        more, width = several, 1  # sums + 0 .. sums + waste
        while width < waste + 1:
            step = min(width, waste + 1 - width)
            more |= more << step
            width += step
        self.take(filling)
        found = (longer | more) & self.present
        self.give_back(filling)
        return bool(found)

    def fillings(self, left: int) -> Iterator[list[int]]:
        """Undominated ways to fill ``left``, of any number of documents, by least waste first,
        and of the same waste those of the longest documents first. The counts must be
        the same whenever the next one is asked for."""
        lengths, most, sums = self.reachable(left)

        def ways(below: int, rest: int) -> Iterator[list[int]]:
            """All that make exactly ``rest`` of the first ``below`` lengths; none is a dead end."""
            if not rest:
                yield []
                return
            for k in range(bisect_right(lengths, rest, 0, below) - 1, -1, -1):
                n = lengths[k]
                for copies in range(min(most[k], rest // n), 0, -1):
                    if sums[k] >> (rest - n * copies) & 1:
                        for others in ways(k, rest - n * copies):
                            yield [n] * copies + others
                if not sums[k] >> rest & 1:
                    return

        totals = sums[-1]
        while totals:
            total = totals.bit_length() - 1
            totals ^= 1 << total
            for filling in ways(len(lengths), total):
                self.tests += 1
                if not self.dominated(filling, left - total):
                    yield filling
                elif self.tests >= TESTS:
                    return

    def options(self, tried: int) -> Iterator[list[int]]:
        """Fillings of a sequence around the longest document left, without the first ``tried``."""
        top = self.longest(self.room)
        self.take([top])
        found = itertools.islice(self.fillings(self.room - top), tried, None)
        while True:
            filling = next(found, None)
            self.give_back([top])
            if filling is None:
                return
            yield [top, *filling]
            self.take([top])

    def better_than(self, incumbent: list[list[int]]) -> list[list[int]]:
        best, wasted = incumbent, 0
        levels: list[list] = []  # a sequence each: options (None: made anew), how many tried, the chosen
        while len(best) > self.bound:
            if not self.present:
                best = [chosen for _, _, chosen in levels]
            elif self.nodes >= NODES or self.tests >= TESTS:
                break
            else:
                self.nodes += 1
                levels.append([self.options(0), 0, None])
                if len(levels) > OPEN_LEVELS:
                    levels[-1 - OPEN_LEVELS][0] = None
            allowed = (len(best) - 1) * self.room - self.total
            # the next option of the deepest sequence whose waste is allowed; else one back
            while levels:
                options, tried, chosen = levels[-1]
                if chosen is not None:
                    self.give_back(chosen)
                    wasted -= self.room - sum(chosen)
                if options is None and wasted <= allowed:
                    options = self.options(tried)
                filling = next(options, None) if wasted <= allowed else None
                if filling is None or wasted + self.room - sum(filling) > allowed:
                    levels.pop()  # the others waste no less
                    continue
                self.take(filling)
                wasted += self.room - sum(filling)
                levels[-1] = [options, tried + 1, filling]
                break
            if not levels:
                break
        return best


def pack_lengths(lengths: list[int], room: int) -> list[list[int]]:
    """Fillings that hold every length once."""
    descending = sorted(lengths, reverse=True)
    incumbent = best_fit_decreasing(descending, room)
    search = Completion(descending, room)
    return incumbent if len(incumbent) <= search.bound else search.better_than(incumbent)


def group_packer(room: int) -> Callable:
    def pack(group: pa.Table) -> pa.Table:
        lengths = group.column("length").to_pylist()
        rows: dict[int, list[int]] = defaultdict(list)
        for row, n in enumerate(lengths):
            rows[n].append(row)
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        base = group.column("_group")[0].as_py() << 32
        for k, filling in enumerate(pack_lengths(lengths, room)):
            at = 0
            for n in filling:
                row = rows[n].pop()
                sequence[row], offset[row] = base + k, at
                at += n
        return group.drop_columns(["_group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
    return pack


def pack_pieces(pieces: DataFrame, room: int = 4096) -> DataFrame:
    """``pieces`` (a stored table with ``length``, 1 to ``room``) with sequence_id and offset.
    All columns are carried along."""
    ship_package(pieces.sparkSession)
    columns = [c for c in pieces.columns if c not in ("_group", "sequence_id", "offset")]
    full = pieces.filter(F.col("length") >= room).select(
        *columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = pieces.filter(F.col("length") < room).select(*columns)
    total = short.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / (room * GROUP_SEQUENCES)))
    # rows in table order, mixed: equal ids don't meet, a repeated task deals the same
    dealt = short.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    schema = T.StructType([*short.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return dealt.groupBy("_group").applyInArrow(group_packer(room), schema).unionByName(full)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (all ids of the sequence), lengths (of its pieces, in order)."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.aggregate("parts.ids", F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"), F.col("parts.length").alias("lengths"))
