"""Language identification of words in code-switched text by a linear-chain conditional random
field, and of documents from it.

A word's evidence for each language is a sum of learned weights: of its affixes (first and last
1 to 4 bytes), of its n-grams (2 to 4 bytes), hashed into a table of fixed size, and of the
lexicon it is in (words that training texts have in one language nearly only). Learned start and
transition weights tie neighbouring words. Forward-backward gives every word's probability of
each language; a document's is the mean over its words, its language the largest (ties: the
first by code point), its score that mean.

Only the fit runs on the driver: on at most ``TRAIN_DOCS`` documents per language, those with the
smallest hash of their id, texts of at most ``TRAIN_BYTES`` first. A longer one, where there are not
enough, is learned from by a run of a quarter as many characters; all are predicted whole. Texts are cut into
runs of words, shuffled and joined, so that the field sees changes of language. Features, the
chain and the decision are numpy operations over slices of many documents. A long text is cut into
runs and parts; the messages between them are carried over, so the result is that of one pass.

A text that is null or has no letter is ``und`` with score 0; so is every text if there was
nothing to learn from. Null languages are not learned from. Repeated rows get equal results.
Other columns are passed through; those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaestor.llm.words import BASE, SPACE, UNBASE, mix, powers, row_slices, text_slices, word_bounds
from quaestor.session import durable, ship_package

TRAIN_DOCS = 200
TRAIN_BYTES = 20_000
CELLS = 1 << 17
STEPS = 40
RUN = 1024
#: the threshold of known n-grams: the share of texts that may lie below, and the steps it is counted in
FEW = 0.02
SHARE_STEPS = 10_000
SLICE = 1 << 20
UNKNOWN = "und"
_BYTE = np.arange(256)
LETTER = ((_BYTE | 32) >= 97) & ((_BYTE | 32) <= 122) | (_BYTE >= 128)
AFFIXES = (1, 2, 3, 4)
GRAMS = (2, 3, 4)


def running_hash(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(running: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int) -> np.ndarray:
    return mix((running[ends] - running[starts]) * powers(UNBASE, len(running))[starts] + np.uint64(kind))


def feature_spans(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, word numbers, span starts, span ends) for every kind of affix and n-gram."""
    length, words = ends - starts, np.arange(len(starts))
    for n in AFFIXES:
        has = length >= n
        yield n, words[has], starts[has], starts[has] + n
        yield 16 + n, words[has], ends[has] - n, ends[has]
    for n in GRAMS:
        many = np.maximum(length - n + 1, 0)
        word = np.repeat(words, many)
        at = np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many) + starts[word]
        yield 32 + n, word, at, at + n


@dataclass
class Field:
    languages: list[str]
    weights: np.ndarray  # CELLS x languages
    lexicon: np.ndarray  # ascending word hashes
    lexicon_language: np.ndarray
    lexicon_weights: np.ndarray  # language of the lexicon x languages
    start: np.ndarray
    transition: np.ndarray  # from x to

    def lexicon_of(self, hashes: np.ndarray) -> np.ndarray:
        """Row of ``lexicon_weights`` for each word; the last (all 0) for words in none."""
        none = len(self.lexicon_weights) - 1
        if not len(self.lexicon):
            return np.full(len(hashes), none)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == hashes, self.lexicon_language[at], none)

    def evidence(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        running = running_hash(data)
        out = self.lexicon_weights[self.lexicon_of(span_hash(running, starts, ends, 0))].astype(np.float64)
        for kind, word, at, to in feature_spans(starts, ends):
            cells = (span_hash(running, at, to, kind) & np.uint64(CELLS - 1)).astype(np.int64)
            if kind < 32:  # one span per word
                out[word] += self.weights[cells]
            else:
                first = np.flatnonzero(np.append(True, word[1:] != word[:-1])[:len(word)])
                if len(first):
                    out[word[first]] += np.add.reduceat(self.weights[cells], first, axis=0)
        return out

    def seen(self) -> np.ndarray:
        """Cells of the weights that training texts have touched."""
        return (self.weights != 0).any(1)

    def familiar(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words_at: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """By text: n-grams of letters of the longest kind that training texts have, and all of them."""
        running, out = running_hash(data), np.zeros((len(words_at) - 1, 2))
        others = np.append(0, np.cumsum(~LETTER[data]))
        for kind, word, at, to in feature_spans(starts, ends):
            if kind == 32 + max(GRAMS):
                letters = others[at] == others[to]
                word, at, to = word[letters], at[letters], to[letters]
                cells = (span_hash(running, at, to, kind) & np.uint64(CELLS - 1)).astype(np.int64)
                text = np.searchsorted(words_at, word, side="right") - 1
                out[:, 0] += np.bincount(text, seen[cells], len(out))
                out[:, 1] += np.bincount(text, minlength=len(out))
        return out

    def marginals(self, evidence: np.ndarray, words_at: np.ndarray, enter: np.ndarray | None = None, leave: np.ndarray | None = None) -> np.ndarray:
        """Forward-backward over all documents of a slice at once. A long one is cut into runs of
        ``RUN`` words; the product of a run's steps tells what comes in from the runs before and
        after it, so the result is that of one pass and takes as many steps as the longest run has
        words. ``enter`` and ``leave``: messages from before and after the slice, of its only document."""
        here, go = np.exp(evidence - evidence.max(1, keepdims=True)), np.exp(self.transition - self.transition.max())
        width, begin = here.shape[1], np.exp(self.start - self.start.max())
        n = np.diff(words_at)
        pieces = np.maximum(-(-n // RUN), 1)
        doc = np.repeat(np.arange(len(n)), pieces)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        runs_at = np.append(words_at[:-1][doc] + place * RUN, words_at[-1])
        enters, leaves = np.tile(begin if enter is None else enter, (len(doc), 1)), np.tile(np.ones(width) if leave is None else leave, (len(doc), 1))
        cut = np.flatnonzero(pieces[doc] > 1)
        if len(cut):
            steps = run_products(here, go, runs_at, cut)
            for first, last in zip(*run_groups(doc[cut])):
                for k in range(first + 1, last):
                    enters[cut[k]] = unit(enters[cut[k - 1]] @ steps[k - 1] @ go)
                for k in range(last - 2, first - 1, -1):
                    leaves[cut[k]] = unit(go @ steps[k + 1] @ leaves[cut[k + 1]])
        return chain_marginals(here, go, runs_at, enters, leaves)

    def whole_step(self, evidence: np.ndarray) -> np.ndarray:
        """The product of all words of a part of a text: ``enter`` times this times the transitions is
        what enters the next part."""
        here, go = np.exp(evidence - evidence.max(1, keepdims=True)), np.exp(self.transition - self.transition.max())
        runs_at = np.append(np.arange(0, len(here), RUN), len(here))
        steps = run_products(here, go, runs_at, np.arange(len(runs_at) - 1))
        out = steps[0]
        for step in steps[1:]:
            out = out @ go @ step
            out = out / out.sum()
        return out

    def messages(self, steps: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """What enters and leaves each part of a text, from the parts' ``whole_step``."""
        go = np.exp(self.transition - self.transition.max())
        enters, leaves = [np.exp(self.start - self.start.max())], [np.ones(len(go))]
        for step in steps[:-1]:
            enters.append(unit(enters[-1] @ step @ go))
        for step in steps[:0:-1]:
            leaves.append(unit(go @ step @ leaves[-1]))
        return enters, leaves[::-1]


def unit(message: np.ndarray) -> np.ndarray:
    return message / message.sum()


def run_groups(owner: np.ndarray) -> tuple[list[int], list[int]]:
    """First and past-last places of equal neighbours."""
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    return first.tolist(), [*first[1:].tolist(), len(owner)]


def run_products(here: np.ndarray, go: np.ndarray, runs_at: np.ndarray, which: np.ndarray) -> np.ndarray:
    """For each of the runs ``which`` the product of its words' evidence and the transitions between them."""
    length = np.diff(runs_at)[which]
    out = np.tile(np.eye(len(go)), (len(which), 1, 1))
    for t in range(int(length.max()) if len(length) else 0):
        on = np.flatnonzero(length > t)
        out[on] = (out[on] @ go if t else out[on]) * here[runs_at[which[on]] + t][:, None, :]
        out[on] /= out[on].sum((1, 2), keepdims=True)
    return out


def chain_marginals(here: np.ndarray, go: np.ndarray, words_at: np.ndarray, enters: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """Probabilities of the languages of the words of many sequences, longest first: at each place those that
    are long enough. ``enters``: of each sequence's first word before its evidence; ``leaves``: at
    its last word."""
    length = np.diff(words_at)
    order = np.argsort(-length, kind="stable")
    begin, length, enters, leaves = words_at[:-1][order], length[order], enters[order], leaves[order]
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), side="left")  # sequences longer than t
    back = np.ascontiguousarray(go.T)
    forward, backward = np.empty_like(here), np.ones_like(here)
    state = enters
    for t in range(steps):
        at = begin[:active[t]] + t
        state = (state[:active[t]] @ go if t else state[:active[t]]) * here[at]
        state /= state.sum(1, keepdims=True)
        forward[at] = state
    filled = np.flatnonzero(length > 0)
    backward[begin[filled] + length[filled] - 1] = leaves[filled]
    state = np.zeros((0, here.shape[1]))
    for t in range(steps - 1, 0, -1):
        at = begin[:active[t]] + t
        now = leaves[:active[t]].copy()
        now[:len(state)] = state
        state = (now * here[at]) @ back
        state /= state.sum(1, keepdims=True)
        backward[at - 1] = state
    both = forward * backward
    return both / np.maximum(both.sum(1, keepdims=True), 1e-300)


def empty_field() -> Field:
    return Field([], np.zeros((CELLS, 0), np.float32), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((1, 0)), np.zeros(0), np.zeros((0, 0)))


def chain_expectations(evidence: np.ndarray, start: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sequences of one length (sequence x step x language): probabilities of languages, and
    expected transitions."""
    here, go = np.exp(evidence - evidence.max(2, keepdims=True)), np.exp(transition - transition.max())
    steps = here.shape[1]
    forward, backward = np.empty_like(here), np.ones_like(here)
    for t in range(steps):
        state = (forward[:, t - 1] @ go if t else np.exp(start - start.max())) * here[:, t]
        forward[:, t] = state / state.sum(1, keepdims=True)
    for t in range(steps - 1, 0, -1):
        state = (backward[:, t] * here[:, t]) @ go.T
        backward[:, t - 1] = state / state.sum(1, keepdims=True)
    both = forward * backward
    both /= both.sum(2, keepdims=True)
    pairs = forward[:, :-1, :, None] * go[None, None] * (here[:, 1:] * backward[:, 1:])[:, :, None, :]
    pairs /= pairs.sum((2, 3), keepdims=True)
    return both, pairs.sum((0, 1))


def fit(texts: list[str], labels: list[str], epochs: int = 3, rate: float = 0.3, batch: int = 64, seed: int = 7) -> Field:
    languages = sorted(set(labels))
    if not languages:
        return empty_field()
    width, rng = len(languages), np.random.default_rng(seed)
    column = pc.utf8_lower(pa.array(texts, pa.large_string()))
    kinds, cells_of, doc_of, hashes = [], [], [], []
    words_before = 0
    for row, data, offsets in text_slices(column, SLICE):
        starts, ends, words_at = word_bounds(data, offsets)
        running = running_hash(data)
        hashes.append(span_hash(running, starts, ends, 0))
        for kind, word, at, to in feature_spans(starts, ends):
            kinds.append((word + words_before).astype(np.int32))
            cells_of.append((span_hash(running, at, to, kind) & np.uint64(CELLS - 1)).astype(np.int32))
        doc_of.append(np.repeat(np.arange(len(words_at) - 1) + row, np.diff(words_at)))
        words_before += len(starts)
    hashes, doc_of = np.concatenate(hashes), np.concatenate(doc_of)
    if not len(hashes):
        return empty_field()
    word_of, cells = np.concatenate(kinds), np.concatenate(cells_of)
    order = np.argsort(word_of, kind="stable")
    cells = cells[order]
    cells_at = np.searchsorted(word_of[order], np.arange(len(hashes) + 1))
    truth = np.array([languages.index(x) for x in labels])[doc_of]

    # the lexicon: words seen 5 times or more, nine in ten of them in one language
    known, inverse = np.unique(hashes, return_inverse=True)
    seen = np.bincount(inverse * width + truth, minlength=len(known) * width).reshape(-1, width)
    sure = (seen.sum(1) >= 5) & (seen.max(1) >= 0.9 * seen.sum(1))
    field = Field(languages, np.zeros((CELLS, width), np.float32), known[sure], seen[sure].argmax(1),
                  np.zeros((width + 1, width)), np.zeros(width), np.zeros((width, width)))
    listed = field.lexicon_of(hashes)

    # runs of words from one text each, shuffled and joined, then cut into sequences
    bounds = np.flatnonzero((rng.random(len(hashes)) < 0.05) | np.append(True, doc_of[1:] != doc_of[:-1]))
    runs = [np.arange(a, b) for a, b in zip(bounds, np.append(bounds[1:], len(hashes)))]
    totals = [np.full(x.shape, 1e-8) for x in (field.weights, field.lexicon_weights, field.start, field.transition)]
    for _ in range(epochs):
        stream = np.concatenate([runs[k] for k in rng.permutation(len(runs))])
        stream = np.resize(stream, -(-len(stream) // STEPS) * STEPS).reshape(-1, STEPS)
        for k in range(0, len(stream), batch):
            words = stream[k:k + batch].ravel()
            counts = cells_at[words + 1] - cells_at[words]
            owner = np.repeat(np.arange(len(words)), counts)
            picked = cells[np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + cells_at[words][owner]]
            evidence = field.lexicon_weights[listed[words]].copy()
            for c in range(width):
                evidence[:, c] += np.bincount(owner, field.weights[picked, c], len(words))
            shape = (-1, STEPS, width)
            expected, pairs = chain_expectations(evidence.reshape(shape), field.start, field.transition)
            observed = np.eye(width)[truth[words]]
            error = observed - expected.reshape(-1, width)
            chain = observed.reshape(shape)
            moves = np.einsum("sti,stj->ij", chain[:, :-1], chain[:, 1:]) - pairs
            scale = 1 / len(chain)
            steps = [np.column_stack([np.bincount(picked, error[owner, c], CELLS) for c in range(width)]),
                     np.column_stack([np.bincount(listed[words], error[:, c], width + 1) for c in range(width)]),
                     (chain[:, 0] - expected.reshape(shape)[:, 0]).sum(0), moves]
            steps[1][-1] = 0
            for value, total, step in zip((field.weights, field.lexicon_weights, field.start, field.transition), totals, steps):
                step = step * scale
                total += step**2
                value += (rate * step / np.sqrt(total)).astype(value.dtype)
    return field


def ranked_texts(docs: DataFrame, learn: Column) -> tuple[Column, DataFrame]:
    """Whether a text is long, and doc_id, lang and ``_rank`` of the texts to learn from, short ones first."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & learn)
    long = F.octet_length("text") > TRAIN_BYTES
    return long, usable.select("doc_id", "lang", long.alias("long")).withColumn("_rank", F.row_number().over(
        Window.partitionBy("lang").orderBy("long", F.xxhash64("doc_id"), "doc_id")))


def training_texts(docs: DataFrame, learn: Column, most: int = TRAIN_DOCS, after: int = 0) -> tuple[list[str], list[str]]:
    """At most ``most`` texts per language, short ones first; those after the first ``after``. ``learn``: condition on doc_id."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & learn)
    long, ranked = ranked_texts(docs, learn)
    ranked = ranked.filter((F.col("_rank") > after) & (F.col("_rank") <= after + most))
    # stored, so that Spark knows how little there is to send
    ranked = durable(ranked.select("doc_id", "lang").distinct(), "training")
    # a long text stands for itself by a run of characters from a place that its id chooses
    most_chars = TRAIN_BYTES // 4
    from_place = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.greatest(F.char_length("text") - most_chars, F.lit(1))).cast("int") + 1
    piece = F.when(long, F.substring("text", from_place, F.lit(most_chars))).otherwise(F.col("text"))
    chosen = usable.select("doc_id", "lang", piece.alias("text")).join(ranked, ["doc_id", "lang"])
    chosen = chosen.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).orderBy("doc_id", "lang")
    rows = chosen.select("text", "lang").collect()
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def language_model(docs: DataFrame, learn: Column, most: int = TRAIN_DOCS) -> Field:
    return fit(*training_texts(docs, learn, most))


def language_runs(chances: np.ndarray, words_at: np.ndarray) -> list[np.ndarray]:
    """Of each text (language number, words) of its runs of one language."""
    word_language = chances.argmax(1) if len(chances) else np.zeros(0, int)
    change = np.ones(len(word_language), bool)
    change[1:] = word_language[1:] != word_language[:-1]
    change[words_at[:-1][np.diff(words_at) > 0]] = True
    at = np.flatnonzero(change)
    size = np.diff(np.append(at, len(word_language)))
    runs_at = np.searchsorted(at, words_at)
    return [np.column_stack([word_language[at[a:b]], size[a:b]]) for a, b in zip(runs_at[:-1], runs_at[1:])]


def identify_slice(field: Field, data: np.ndarray, offsets: np.ndarray, spans: bool) -> tuple[np.ndarray, list]:
    """Mean chances of each text, and its runs."""
    starts, ends, words_at = word_bounds(data, offsets)
    chances = field.marginals(field.evidence(data, starts, ends), words_at)
    sums = np.zeros((len(chances) + 1, chances.shape[1]))
    np.cumsum(chances, axis=0, out=sums[1:])
    means = (sums[words_at[1:]] - sums[words_at[:-1]]) / np.maximum(np.diff(words_at), 1)[:, None]
    return means, language_runs(chances, words_at) if spans else []


def text_parts(data: np.ndarray) -> list[np.ndarray]:
    """A long text in parts that end between words."""
    cuts = [0]
    while cuts[-1] < len(data):
        end = cuts[-1] + SLICE
        while end < len(data) and not SPACE[data[end]]:
            end += 1
        cuts.append(min(end, len(data)))
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def identify_long(field: Field, data: np.ndarray, spans: bool) -> tuple[np.ndarray, list]:
    """The same of one long text, in parts that end between words: first what passes from part to part,
    then each part with that. Memory goes with a part, not with the text."""
    parts = text_parts(data)

    def evidence(part: np.ndarray) -> np.ndarray:
        starts, ends, _ = word_bounds(part, np.array([0, len(part)]))
        return field.evidence(part, starts, ends)

    worded = [part for part in parts if not SPACE[part].all()]
    if not worded:
        return np.zeros((1, len(field.languages))), [np.zeros((0, 2), int)] if spans else []
    enters, leaves = field.messages([field.whole_step(evidence(part)) for part in worded])
    total, words, runs = np.zeros(len(field.languages)), 0, []
    for part, enter, leave in zip(worded, enters, leaves):
        clues = evidence(part)
        chances = field.marginals(clues, np.array([0, len(clues)]), enter, leave)
        total, words = total + chances.sum(0), words + len(chances)
        runs.append(language_runs(chances, np.array([0, len(chances)]))[0])
    joined = np.concatenate(runs)
    first = np.flatnonzero(np.append(True, joined[1:, 0] != joined[:-1, 0]))
    joined = np.column_stack([joined[first, 0], np.add.reduceat(joined[:, 1], first)])
    return (total / words)[None, :], [joined] if spans else []


def familiar_shares(field: Field, texts: pa.Array) -> np.ndarray:
    """Of each text the share of its n-grams that training texts have: low where a text is in no learned
    language, however sure the field is of the nearest one. Few n-grams say little, so this is the
    upper end of where the share may lie (two deviations, 1 at most; 1 for a text without any)."""
    out, seen = np.ones(len(texts)), field.seen()
    for row, part in row_slices(texts, SLICE):
        _, data, offsets = next(text_slices(pc.utf8_lower(part.fill_null("")), 1 << 62))
        if len(part) == 1 and len(data) > 2 * SLICE:
            counts = sum(field.familiar(piece, *word_bounds(piece, np.array([0, len(piece)])), seen) for piece in text_parts(data))
        else:
            counts = field.familiar(data, *word_bounds(data, offsets), seen)
        many = np.maximum(counts[:, 1], 1)
        out[row:row + len(part)] = np.where(counts[:, 1] > 0, np.minimum(counts[:, 0] / many + 1 / np.sqrt(many), 1), 1.0)
    return out


def familiar_floor(judged: DataFrame, learn: Column) -> float:
    """The share below which a text is of no learned language: well under what all but a few of the texts
    with a language have, which were not learned from. ``judged``: doc_id, lang, text and lang_familiar of all
    documents. Counted over all of them, in steps of 1 / ``SHARE_STEPS``; without such texts 0."""
    _, ranked = ranked_texts(judged, learn)
    learned = ranked.filter(F.col("_rank") <= TRAIN_DOCS).select("doc_id", "lang").distinct()
    usable = judged.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & learn)
    rest = usable.select("doc_id", "lang", "lang_familiar").join(F.broadcast(learned), ["doc_id", "lang"], "left_anti")
    step = F.floor(F.col("lang_familiar") * SHARE_STEPS).cast("int").alias("step")
    counts = sorted((r["step"], r["n"]) for r in rest.groupBy(step).agg(F.count("*").alias("n")).collect())
    below, most = 0, FEW * sum(n for _, n in counts)
    for share, n in counts:
        below += n
        if below > most:
            return 0.8 * share / SHARE_STEPS
    return 0.0


def identify(field: Field, texts: pa.Array, spans: bool = True) -> tuple[np.ndarray, np.ndarray, list]:
    """Language number (-1: unknown) and score of each text, and with ``spans`` its runs of
    words of one language as (language number, words)."""
    best, score, runs = np.full(len(texts), -1), np.zeros(len(texts)), []
    if not field.languages:
        return best, score, [[] for _ in range(len(texts))]
    for row, part in row_slices(texts, SLICE):
        part = pc.utf8_lower(part.fill_null(""))
        known = pc.match_substring_regex(part, r"\p{L}").to_numpy(zero_copy_only=False)
        _, data, offsets = next(text_slices(part, 1 << 62))
        if len(part) == 1 and len(data) > 2 * SLICE:
            means, mine = identify_long(field, data, spans)
        else:
            means, mine = identify_slice(field, data, offsets, spans)
        best[row:row + len(part)] = np.where(known, means.argmax(1), -1)
        score[row:row + len(part)] = np.where(known, np.minimum(means.max(1), 1), 0)
        runs.extend(mine)
    return best, score, runs


def labeller(field, schema: list[str], spans: bool, familiar: bool) -> Callable:
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = field.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            best, score, runs = identify(model, batch.column("text"), spans)
            columns = [batch.column(c) for c in schema] + [pa.array(names[best], pa.string()), pa.array(score)]
            if familiar:
                columns.append(pa.array(familiar_shares(model, batch.column("text"))))
            if spans:
                columns.append(pa.array([[{"lang": names[k], "words": int(n)} for k, n in r] for r in runs],
                                        pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(columns, [*schema, "lang_pred", "lang_score"] + ["lang_familiar"] * familiar + ["lang_spans"] * spans)
    return label


def identify_languages(docs: DataFrame, field: Field, spans: bool = False, familiar: bool = False) -> DataFrame:
    """``docs`` with lang_pred and lang_score; with ``familiar`` also lang_familiar (``familiar_shares``),
    and with ``spans`` lang_spans: the text's words as runs of one language, in order."""
    spark = docs.sparkSession
    ship_package(spark)
    keep = [f for f in docs.schema.fields if f.name not in ("lang_pred", "lang_score", "lang_familiar", "lang_spans")]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    if familiar:
        schema = schema.add("lang_familiar", T.DoubleType())
    if spans:
        schema = schema.add("lang_spans", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("words", T.IntegerType())])))
    return docs.select(*names).mapInArrow(labeller(spark.sparkContext.broadcast(field), names, spans, familiar), schema)
