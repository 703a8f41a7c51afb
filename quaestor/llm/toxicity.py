"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model over
their votes, and a linear classifier trained on its posterior labels.

Voters look at a whole text and vote "toxic" or abstain:

* lexicons by theme, found as words, in disguise (digits and signs for letters, drawn-out letters),
  and addressed (with a second person nearby);
* mined patterns: words and beginnings of words whose presence goes with label 1 in the labelled
  documents, each with the number of occurrences at which it votes;
* shape: shouting, runs of exclamation marks.

The label model says how likely each combination of votes is given the hidden label. Voters are
not independent, so it is a tree for each label: each voter depends on the label and on one other
voter, that with which it shares most information given the label. Accuracies and correlations are
estimated by expectation maximisation over the votes of all documents, counted once per
combination; labelled documents keep their label, and the unlabelled count as much as the labelled
together at most, so that a crowd of equal texts cannot take over the hidden label.

A logistic regression on counts of the patterns, lexicons and shapes learns the posterior labels
of at most ``TRAIN_ROWS`` documents, labelled ones first; its score is the result.

Statistics are numpy operations on the UTF-8 buffers of many documents. Labels are learned from at
most ``LABELLED_ROWS`` ids (equal texts once); votes are counted over all documents; what comes to the driver is bounded by
numbers of patterns and voters, and the training sample.

Null texts are empty ones; an empty text gets the score of one without any vote. Null labels are
left out, contradicting labels of one id averaged, null ids scored and never learned from. Without
labels of both classes nothing is mined and every score is the share of label 1 (0.5 without
labels). Repeated rows get equal scores. Other columns are passed through; one named like the
result is replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaestor.llm.words import BASE, UNBASE, mix, powers, row_slices, text_slices
from quaestor.session import durable, ship_package

LABELLED_ROWS = 40_000
TRAIN_ROWS = 20_000
MINED = 192
VOTING = 48
ROUNDS = 6
#: lengths of word beginnings in bytes, apart from the whole word
BEGINNINGS = (4, 5, 6, 7, 8, 9)

# Words of abuse and address in the languages of the tables.
LEXICONS = {
    "insult": "idiot idiots moron morons imbecile fool stupid dumb clown loser losers trash garbage "
              "idiotin dummkopf trottel depp versager abschaum imbécile crétin débile abruti idiota imbécil estúpido tonto basura",
    "contempt": "pathetic worthless disgusting scum vermin filth useless despicable wertlos erbärmlich widerlich "
                "pathétique dégoûtant minable patético asqueroso inútil",
    "vulgar": "fuck fucking shit bitch bastard asshole crap scheisse scheiße arschloch merde connard salope putain mierda cabrón puta",
    "threat": "kill hang shoot hurt destroy umbringen töten crève tuer matar muérete",
    "hate": "hate hates subhuman parasite parasites inferior hasse untermensch parasit haine odio parásito",
}
ADDRESS = "you your yours youre u ur du dich dir dein ihr euch tu te toi ton vous votre tú usted eres"
DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"}

_BYTE = np.arange(256)
CAPITAL = (_BYTE >= 65) & (_BYTE <= 90)
LETTER = CAPITAL | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
SPACE = _BYTE <= 32
PLAIN = np.array([ord(DISGUISE.get(chr(b), "\0")) if chr(b) in DISGUISE else (b if LETTER[b] else 0) for b in range(256)], np.uint8)
NEARBY = 4

SHAPES = [f"{theme}_{form}" for theme in LEXICONS for form in ("plain", "disguised", "addressed")] + ["shouting", "exclaiming", "words"]


# --- words and patterns of a slice ---------------------------------------------------------

def running_hash(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(running: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int) -> np.ndarray:
    """Of whole words (kind 0) and of beginnings of a length (kind: that length)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    return mix((running[ends] - running[starts]) * powers(UNBASE, len(running))[starts] + np.uint64(kind))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside``, none across the beginning of a row."""
    padded = np.zeros(len(inside) + 2, bool)
    padded[1:-1] = inside
    first = np.zeros(len(inside) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside & (~padded[:-2] | first[:-1]))
    ends = np.flatnonzero(inside & (~padded[2:] | first[1:])) + 1
    return starts, ends


def word_list_hashes(words: str) -> np.ndarray:
    found = []
    for word in words.split():
        data = np.frombuffer(word.encode(), np.uint8)
        found.append(span_hash(running_hash(data), np.array([0]), np.array([len(data)]), 0))
    return np.sort(np.concatenate(found))


def bare(word: str) -> str:
    """Letters with none drawn out."""
    return "".join(c for k, c in enumerate(word) if k == 0 or c != word[k - 1])


def member(hashes: np.ndarray, listed: np.ndarray) -> np.ndarray:
    if not len(listed):
        return np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(listed, hashes), len(listed) - 1)
    return listed[at] == hashes


class Lists:
    """Hashes of the lexicons, plain and bare, and of the words of address; made once per worker."""

    def __init__(self) -> None:
        self.plain = {theme: word_list_hashes(words) for theme, words in LEXICONS.items()}
        self.bare = {theme: word_list_hashes(" ".join(bare(w) for w in words.split())) for theme, words in LEXICONS.items()}
        self.address = word_list_hashes(ADDRESS)


@functools.cache
def known_lists() -> Lists:
    return Lists()


@dataclass
class Slice:
    """Words (runs of letters) of a slice of lower-cased texts."""
    rows: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    words_at: np.ndarray
    running: np.ndarray
    original: np.ndarray
    original_offsets: np.ndarray

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.words_at))

    def beginnings(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word numbers, hashes) of whole words and of longer words' beginnings."""
        yield np.arange(len(self.starts)), span_hash(self.running, self.starts, self.ends, 0)
        length = self.ends - self.starts
        for n in BEGINNINGS:
            has = np.flatnonzero(length > n)
            yield has, span_hash(self.running, self.starts[has], self.starts[has] + n, n)


def read_slices(texts: pa.Array) -> Iterator[tuple[int, Slice]]:
    for row, part in row_slices(texts):
        part = part.fill_null("")
        _, original, original_offsets = next(text_slices(part, 1 << 62))
        _, data, offsets = next(text_slices(pc.utf8_lower(part), 1 << 62))
        starts, ends = runs(LETTER[data], offsets)
        yield row, Slice(len(part), data, offsets, starts, ends, np.searchsorted(starts, offsets), running_hash(data), original, original_offsets)


def per_row(at: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(at, minlength=rows).astype(float)


def shape_counts(piece: Slice, lists: Lists) -> np.ndarray:
    """Occurrences by row of what ``SHAPES`` lists."""
    row, whole = piece.row_of(), span_hash(piece.running, piece.starts, piece.ends, 0)
    tokens, token_ends = runs(~SPACE[piece.data], piece.offsets)
    token_row = np.searchsorted(piece.offsets, tokens, side="right") - 1
    # tokens as their letters, signs read as letters and none drawn out
    plain = PLAIN[piece.data]
    token_of = np.zeros(len(piece.data) + 1, np.int64)
    token_of[tokens] = 1
    token_of = np.cumsum(token_of[:-1]) - 1
    kept = plain > 0
    kept[1:] &= (plain[1:] != plain[:-1]) | (token_of[1:] != token_of[:-1])
    kept_data, kept_token = plain[kept], token_of[kept]
    kept_at = np.searchsorted(kept_token, np.arange(len(tokens) + 1))
    bare_hashes = span_hash(running_hash(kept_data), kept_at[:-1], kept_at[1:], 0)
    # a disguise has a sign for a letter or a letter three times in a row
    sign, letter = (plain > 0) & ~LETTER[piece.data], LETTER[piece.data]
    drawn = np.zeros(len(letter), bool)
    drawn[2:] = letter[2:] & (piece.data[2:] == piece.data[1:-1]) & (piece.data[2:] == piece.data[:-2]) & (token_of[2:] == token_of[:-2])
    odd = np.bincount(token_of[sign | drawn], minlength=len(tokens)) > 0 if len(tokens) else np.zeros(0, bool)

    address = np.cumsum(np.append(0, member(whole, lists.address)))
    low = np.maximum(np.arange(len(whole)) - NEARBY, piece.words_at[row]) if len(whole) else row
    high = np.minimum(np.arange(len(whole)) + NEARBY + 1, piece.words_at[row + 1]) if len(whole) else row
    addressed = address[high] > address[low]
    columns = []
    for theme in LEXICONS:
        hit = member(whole, lists.plain[theme])
        disguised = member(bare_hashes, lists.bare[theme]) & odd
        columns += [per_row(row[hit], piece.rows), per_row(token_row[disguised], piece.rows), per_row(row[hit & addressed], piece.rows)]
    raw, at = piece.original, piece.original_offsets
    words, ends = runs(LETTER[raw], at)
    capitals = np.append(0, np.cumsum(CAPITAL[raw]))
    loud = (ends - words >= 4) & (capitals[ends] - capitals[words] == ends - words)
    marks, mark_ends = runs(raw == 33, at)
    place = lambda starts: np.searchsorted(at, starts, side="right") - 1
    columns += [per_row(place(words[loud]), piece.rows), per_row(place(marks[mark_ends - marks >= 3]), piece.rows), np.diff(piece.words_at).astype(float)]
    return np.column_stack(columns)


def pattern_counts(piece: Slice, patterns: np.ndarray) -> np.ndarray:
    """Occurrences by row of each of the ascending pattern hashes."""
    out = np.zeros(piece.rows * len(patterns))
    row = piece.row_of()
    if len(patterns):
        for word, hashes in piece.beginnings():
            at = np.minimum(np.searchsorted(patterns, hashes), len(patterns) - 1)
            hit = np.flatnonzero(patterns[at] == hashes)
            out += np.bincount(row[word[hit]] * len(patterns) + at[hit], minlength=len(out))
    return out.reshape(piece.rows, -1)


def column_counts(texts: pa.Array, patterns: np.ndarray, lists: Lists) -> np.ndarray:
    """Shapes, then patterns, by row."""
    parts = [np.column_stack([shape_counts(piece, lists), pattern_counts(piece, patterns)]) for _, piece in read_slices(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, len(SHAPES) + len(patterns)))


# --- mining ------------------------------------------------------------------------------------

def labelled_documents(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = LABELLED_ROWS) -> DataFrame:
    """h, label, text of the documents of at most ``rows`` labelled ids, those with the smallest hash;
    equal texts once, with their mean label."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.avg("toxic").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    return joined.groupBy(F.xxhash64("text").alias("h"), F.md5("text").alias("m")).agg(F.avg("label").alias("label"), F.min("text").alias("text")).select("h", "label", "text")


def miner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pattern, at_least, toxic, clean, mark: in how many documents (by label) a pattern occurs once,
    twice, four times or more, and a mark of which these are; summed per slice."""
    for batch in batches:
        label, marks = batch.column("label").to_numpy(), batch.column("h").to_numpy()
        for first, piece in read_slices(batch.column("text")):
            row = piece.row_of()
            hashes, rows = [], []
            for word, found in piece.beginnings():
                hashes.append(found)
                rows.append(row[word])
            hashes, rows = np.concatenate(hashes), np.concatenate(rows)
            order = np.lexsort([rows, hashes])
            hashes, rows = hashes[order], rows[order]
            new = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1]))) if len(hashes) else np.zeros(0, int)
            counts = np.diff(np.append(new, len(hashes)))
            hashes, weight, mark = hashes[new], label[first + rows[new]], marks[first + rows[new]]
            for least in (1, 2, 4):
                has = np.flatnonzero(counts >= least)
                known, begins, at = np.unique(hashes[has], return_index=True, return_inverse=True)
                if not len(known):
                    continue
                toxic = np.bincount(at, weight[has], len(known))
                yield pa.RecordBatch.from_arrays([
                    pa.array(known.view(np.int64)), pa.array(np.full(len(known), least, np.int32)), pa.array(toxic),
                    pa.array(np.bincount(at, 1 - weight[has], len(known))), pa.array(np.bitwise_xor.reduceat(mark[has], begins))],
                    ["pattern", "at_least", "toxic", "clean", "mark"])


def mine(labelled: DataFrame, toxic: float, clean: float, most: int = MINED) -> tuple[np.ndarray, np.ndarray]:
    """Pattern hashes, best first, and the number of occurrences from which each votes: those with the
    highest lower bound on how much oftener they stand in toxic documents (``toxic`` of them) than in
    clean ones; of several that stand in the very same documents one."""
    counted = labelled.mapInArrow(miner, "pattern long, at_least int, toxic double, clean double, mark long")
    counted = counted.groupBy("pattern", "at_least").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_xor("mark").alias("mark")).filter("toxic >= 3")
    share = lambda n, of: (F.col(n) + 0.5) / (of + 1.0)
    # log odds less twice their standard error
    gain = F.log(share("toxic", toxic) / share("clean", clean)) - 2 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    ranked = counted.withColumn("gain", gain).filter("gain > 0").withColumn("score", F.col("gain") * F.sqrt("toxic"))
    best = ranked.groupBy("mark", "toxic", "clean").agg(F.max(F.struct("score", "at_least", "pattern")).alias("best"))
    best = best.groupBy("best.pattern").agg(F.max(F.struct("best.score", "best.at_least")).alias("best"))
    rows = best.orderBy(F.desc("best"), "pattern").limit(most).select("pattern", "best.at_least").toArrow()
    return rows.column("pattern").to_numpy().view(np.uint64), rows.column("at_least").to_numpy().astype(float)


# --- the label model -------------------------------------------------------------------------------

@dataclass
class LabelModel:
    """P(label), and for each voter its parent (-1: none) and P(it votes | label, parent's vote)."""
    prior: float
    parent: np.ndarray
    chance: np.ndarray  # voter x label x parent's vote

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(label 1) of rows of votes (0 or 1)."""
        votes = votes.astype(np.int64)
        total = np.log([1 - self.prior, self.prior])[None, :].repeat(len(votes), 0)
        for v, parent in enumerate(self.parent):
            given = votes[:, parent] if parent >= 0 else np.zeros(len(votes), np.int64)
            p = self.chance[v][:, given].T
            total += np.log(np.where(votes[:, v:v + 1] == 1, p, 1 - p))
        total -= total.max(1, keepdims=True)
        odds = np.exp(total)
        return odds[:, 1] / odds.sum(1)

    def accuracy(self) -> np.ndarray:
        """P(label 1 | the voter votes), its parent's vote summed over."""
        fires = np.zeros((len(self.parent), 2))
        for v in range(len(self.parent)):
            fires[v] = self._rate(v)
        odds = fires * np.array([1 - self.prior, self.prior])
        return odds[:, 1] / np.maximum(odds.sum(1), 1e-300)

    def _rate(self, v: int) -> np.ndarray:
        if self.parent[v] < 0:
            return self.chance[v][:, 0]
        up = self._rate(self.parent[v])
        return self.chance[v][:, 0] * (1 - up) + self.chance[v][:, 1] * up


def spanning_tree(joint: np.ndarray) -> np.ndarray:
    """Parent of each voter in the tree of most shared information given the label. ``joint``: label x
    voter x voter, weights with which both vote; the diagonal has each one's own."""
    k = joint.shape[1]
    shared = np.zeros((k, k))
    weight = joint[:, k - 1, k - 1] if k else np.zeros(2)  # the last row is the voter that always votes
    for label in range(2):
        n = max(weight[label], 1e-9)
        both = joint[label] / n
        one = np.diag(both)
        for a, pa_ in ((1, one), (0, 1 - one)):
            for b, pb_ in ((1, one), (0, 1 - one)):
                p = both if a and b else one[:, None] - both if a else one[None, :] - both if b else 1 - one[:, None] - one[None, :] + both
                p = np.maximum(p, 1e-12)
                shared += n * p * np.log(p / np.maximum(np.outer(pa_, pb_), 1e-12))
    voters = k - 1
    parent = np.full(voters, -1)
    best, via = np.full(voters, -np.inf), np.full(voters, -1)
    left = set(range(voters))
    while left:
        v = max(left, key=lambda x: (best[x], -x))
        left.remove(v)
        parent[v] = via[v]
        for u in left:
            if shared[v, u] > best[u]:
                best[u], via[u] = shared[v, u], v
    return parent


def model_of(joint: np.ndarray) -> LabelModel:
    """From weights of joint votes (label x voter x voter, the last voter always votes)."""
    voters = joint.shape[1] - 1
    weight = joint[:, voters, voters]
    parent = spanning_tree(joint)
    chance = np.zeros((voters, 2, 2))
    for v in range(voters):
        rate = (joint[:, v, v] + 0.05) / (weight + 1.0)
        u = parent[v]
        if u < 0:
            chance[v] = rate[:, None]
            continue
        with_parent, alone = joint[:, u, u], weight - joint[:, u, u]
        # few cases lean on the voter's rate without its parent
        chance[v][:, 1] = (joint[:, v, u] + 2 * rate) / (with_parent + 2)
        chance[v][:, 0] = (joint[:, v, v] - joint[:, v, u] + 2 * rate) / (alone + 2)
    return LabelModel(float(np.clip((weight[1] + 0.5) / (weight.sum() + 1.0), 1e-4, 1 - 1e-4)), parent, np.clip(chance, 1e-5, 1 - 1e-5))


def unpack(packed: np.ndarray, voters: int) -> np.ndarray:
    return (packed.astype(np.uint64)[:, None] >> np.arange(voters, dtype=np.uint64)[None, :] & np.uint64(1)).astype(np.int8)


def joint_votes(model: LabelModel | None, voters: int) -> Callable:
    """Rows of cell, weight: the label model's sums over combinations (votes, label or null, weight)."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, voters + 1, voters + 1))
        for batch in batches:
            votes = np.column_stack([unpack(batch.column("votes").to_numpy(), voters), np.ones(batch.num_rows, np.int8)]).astype(float)
            label = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
            weight = batch.column("weight").to_numpy()
            chance = np.where(np.isnan(label), model.posterior(votes[:, :-1]) if model is not None else 0.0, np.nan_to_num(label))
            for y, part in ((0, (1 - chance) * weight), (1, chance * weight)):
                total[y] += (votes * part[:, None]).T @ votes
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total.ravel()[cells])], ["cell", "weight"])
    return sums


def fit_label_model(combinations: DataFrame, voters: int, rounds: int = ROUNDS) -> LabelModel:
    """``combinations``: stored votes (a bit per voter), label (null: unknown), weight."""
    def sums(rows: DataFrame, model: LabelModel | None) -> np.ndarray:
        found = rows.mapInArrow(joint_votes(model, voters), "cell int, weight double").groupBy("cell").agg(F.sum("weight").alias("weight")).toArrow()
        out = np.zeros(2 * (voters + 1)**2)
        out[found.column("cell").to_numpy()] = found.column("weight").to_numpy()
        return out.reshape(2, voters + 1, voters + 1)

    sure = sums(combinations.filter("label IS NOT NULL"), None)
    model = model_of(sure)
    unknown = combinations.filter("label IS NULL")
    for _ in range(rounds):
        guessed = sums(unknown, model)
        held, all_guessed = sure[:, voters, voters].sum(), guessed[:, voters, voters].sum()
        if not all_guessed:
            break
        model = model_of(sure + guessed * min(1.0, held / all_guessed))
    return model


# --- the linear classifier ------------------------------------------------------------------------------

@dataclass
class Linear:
    middle: np.ndarray
    spread: np.ndarray
    weight: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weight):
            return np.full(len(x), 1 / (1 + np.exp(-self.start)))
        return 1 / (1 + np.exp(-np.clip((x - self.middle) / self.spread @ self.weight + self.start, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 2.0, steps: int = 25) -> Linear:
    """Logistic regression by Newton steps; ``y``: 0 to 1."""
    mean = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
    width = x.shape[1]
    middle = x.mean(0) if len(x) else np.zeros(width)
    spread = np.maximum(x.std(0), 0.02) if len(x) else np.ones(width)
    out = Linear(middle, spread, np.zeros(width), float(np.log(mean / (1 - mean))))
    if not len(y) or y.min() == y.max():
        return out
    z = np.column_stack([(x - middle) / spread, np.ones(len(x))])
    penalty = np.full(width + 1, ridge)
    penalty[-1] = 1e-6
    beta = np.append(out.weight, out.start)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        slope = z.T @ (y - p) - penalty * beta
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty), slope)
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        beta = beta + step
        if np.abs(step).max() < 1e-5:
            break
    return Linear(middle, spread, beta[:-1], float(beta[-1]))


def constant(share: float) -> Linear:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Linear(np.zeros(0), np.ones(0), np.zeros(0), float(np.log(share / (1 - share))))


# --- whole tables ---------------------------------------------------------------------------------------

@dataclass
class ToxicityModel:
    patterns: np.ndarray
    least: np.ndarray  # occurrences from which a pattern votes
    voters: np.ndarray  # columns of the counts that vote
    threshold: np.ndarray
    labels: LabelModel | None
    linear: Linear
    names: list[str]

    def counts(self, texts: pa.Array) -> np.ndarray:
        return column_counts(texts, self.patterns, known_lists())

    def votes(self, counts: np.ndarray) -> np.ndarray:
        return (counts[:, self.voters] >= self.threshold).astype(np.int8)

    def features(self, counts: np.ndarray) -> np.ndarray:
        """Counts of shapes and patterns, dampened, and their share of the words."""
        words = np.maximum(counts[:, [len(SHAPES) - 1]], 1)
        mined = counts[:, len(SHAPES):]
        total = mined.sum(1, keepdims=True)
        fired = (mined >= self.least[None, :]).sum(1, keepdims=True) if mined.shape[1] else np.zeros((len(counts), 1))
        return np.column_stack([np.log1p(counts), np.log1p(total), np.log1p(fired), np.sqrt(total / words)])

    def report(self) -> list[tuple[str, float, str | None]]:
        """(voter, P(toxic | it votes), the voter it leans on)."""
        if self.labels is None:
            return []
        return [(self.names[v], float(a), self.names[u] if u >= 0 else None) for v, (a, u) in enumerate(zip(self.labels.accuracy(), self.labels.parent))]


def vote_packer(model, keep: list[str]) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = model.value.votes(model.value.counts(batch.column("text"))).astype(np.uint64)
            packed = (votes << np.arange(votes.shape[1], dtype=np.uint64)[None, :]).sum(1, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(packed.view(np.int64))], [*keep, "votes"])
    return pack


def toxicity_model(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = TRAIN_ROWS, mined: int = MINED, voting: int = VOTING) -> ToxicityModel:
    """``learn``: condition on doc_id for labels that may be learned from."""
    spark = docs.sparkSession
    ship_package(spark)
    labelled = durable(labelled_documents(docs, labels, learn), "labelled")
    totals = labelled.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    toxic, clean = totals[0] or 0.0, totals[1] or 0.0
    none = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, int), np.zeros(0), None, fit_linear(np.zeros((0, 0)), np.zeros(0)), [])
    if not toxic or not clean:
        none.linear = constant(toxic / (toxic + clean) if toxic + clean else 0.5)
        return none
    found, from_count = mine(labelled, toxic, clean, mined)
    shapes = len(SHAPES) - 1  # the number of words is no voter
    room = max(0, min(voting, 62) - shapes)
    order = np.argsort(found)
    patterns, least = found[order], from_count[order]
    chosen = np.sort(np.argsort(order)[:room])  # the best, as places in the ascending patterns
    voters = np.append(np.arange(shapes), len(SHAPES) + chosen)
    threshold = np.append(np.ones(shapes), least[chosen])
    names = SHAPES[:shapes] + [f"pattern_{patterns[c]:016x}" for c in chosen]
    model = ToxicityModel(patterns, least, voters, threshold, None, none.linear, names)

    # votes of all documents, once per combination; labelled texts with their label
    shared = spark.sparkContext.broadcast(model)
    voted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(vote_packer(shared, []), "votes long")
    unknown = voted.groupBy("votes").agg(F.count("*").cast("double").alias("weight")).withColumn("label", F.lit(None).cast("double"))
    known = labelled.mapInArrow(vote_packer(shared, ["label"]), "label double, votes long")
    known = known.groupBy("votes", "label").agg(F.count("*").cast("double").alias("weight"))
    combinations = durable(unknown.select("votes", "label", "weight").unionByName(known), "votes")
    model.labels = fit_label_model(combinations, len(voters))
    x, y = training_sample(docs, labelled, model, rows)
    model.linear = fit_linear(model.features(x), y)
    return model


def smallest(numbers: DataFrame, rows: int) -> int:
    """The largest of the ``rows`` smallest values of ``h``."""
    return numbers.orderBy("h").limit(rows).agg(F.max("h")).first()[0]


def training_sample(docs: DataFrame, labelled: DataFrame, model: ToxicityModel, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and posterior labels of at most ``rows`` texts: labelled ones, filled up with others,
    those of the smallest digests. A labelled text's posterior leans on its label as on one more voter."""
    spark = docs.sparkSession
    held = labelled.count()
    sample = labelled.filter(F.col("h") <= smallest(labelled.select("h"), rows)).select("label", "text")
    if held < rows:
        # equal texts once here too; only numbers are sorted, and the chosen texts alone are sent
        others = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        others = others.withColumn("h", F.xxhash64("text", F.lit(3)))
        chosen = others.filter(F.col("h") <= smallest(others.select("h").distinct(), rows - held))
        chosen = chosen.groupBy("h").agg(F.min("text").alias("text"))
        sample = sample.unionByName(chosen.select(F.lit(None).cast("double").alias("label"), "text"))
    shared = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = shared.value.counts(batch.column("text")).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, counts.size + 1, counts.shape[1]), pa.int32()), pa.array(counts.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("label"), lists], ["label", "x"])

    found = sample.mapInArrow(measure, "label double, x array<float>").toArrow()
    width = len(SHAPES) + len(model.patterns)
    if not len(found):
        return np.zeros((0, width)), np.zeros(0)
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(-1, width).astype(float)
    label = found.column("label").to_numpy().astype(float)
    posterior = model.labels.posterior(model.votes(x))
    return x, np.where(np.isnan(label), posterior, 0.9 * np.nan_to_num(label) + 0.1 * posterior)


def scorer(model, text: str, schema: list[str]) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = model.value.counts(batch.column(text))
            scores = model.value.linear.score(model.value.features(counts))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in schema] + [pa.array(scores)], [*schema, "score"])
    return score


def toxicity_scores(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` with ``score``: 0 to 1, higher where label 1 is likelier."""
    spark = docs.sparkSession
    ship_package(spark)
    keep = [f for f in docs.schema.fields if f.name != "score"]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField("score", T.DoubleType())])
    return docs.select(*names).mapInArrow(scorer(spark.sparkContext.broadcast(model), text, names), schema)
