"""Approximate nearest neighbours by largest inner product: an inverted-list index scanned with
an adaptive number of dimensions.

Vectors are turned by one random rotation, after which any block of coordinates is a fair sample
of the whole. In a probed list the partial inner product over the first blocks estimates the
full one; a candidate is abandoned as soon as the hypothesis that it reaches the query's
threshold is rejected, or Cauchy-Schwarz rules it out. What remains is scored exactly in double
precision on the original vectors, summed in the order of their columns, so that equal vectors have
equal scores and reruns agree. The threshold is the 2 k-th best among a sample, which the
k-th best overall exceeds, and rises within a list. A query that finds fewer than k that way
takes the rest from the sample.

Fitted on bounded samples: the lists' centres on at most ``SAMPLE`` vectors, the number of lists
probed on ``TRIALS`` queries whose true neighbours are found by comparing them with all vectors,
so that on them ``recall`` is reached. Every vector is indexed and every query answered. A list
is dealt into blocks of bounded size, and the queries that probe it too, so no task grows with
a crowded list.

Vectors that are null, zero, of another length than most, or that hold null or non-finite
numbers take no part. Rows equal in id and vector count once; a query never finds its own id. Ties
go to the smaller id. Fewer candidates than k are all returned. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.session import durable, ship_package

SAMPLE = 16_384
TRIALS = 200
LIST_BLOCK = 4_096
QUERY_BLOCK = 1_024
RUN = 1_024
COLUMNS = 16
#: of a score, as a share of the lengths: more than sums of doubles in any order can be apart
ROUNDING = 1e-11
#: deviations below the threshold at which an estimate is given up
DOUBT = 2.6
FOUND = "query_id long, vec_id long, score double"


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64, copy=False)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, each summed from the first column to the last, so that a vector's score is the
    same wherever it stands. (Matrix products sum some rows in another order.)"""
    return np.cumsum(x * q, axis=1)[:, -1]


def top_exact(x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the k best rows: a matrix product leaves those that may be among
    them, with room for its rounding."""
    rough = x @ q
    kept = np.arange(len(x))
    if len(x) > k:
        slack = ROUNDING * np.sqrt((q @ q) * np.einsum("ij,ij->i", x, x))
        low = np.partition(rough - slack, len(x) - k)[len(x) - k]
        kept = np.flatnonzero(rough + slack >= low)
    scores = exact_scores(x[kept], q)
    chosen = best(scores, ids[kept], k)
    return kept[chosen], scores[chosen]


@dataclass
class Index:
    rotation: np.ndarray
    centres: np.ndarray
    sample: np.ndarray
    sample_ids: np.ndarray
    blocks: np.ndarray | None = None  # of each list
    probes: int = 1

    def lists(self, x: np.ndarray) -> np.ndarray:
        half = (self.centres**2).sum(1) / 2
        return np.concatenate([(x[a:a + 4096] @ self.centres.T - half).argmax(1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)

    def order(self, q: np.ndarray) -> np.ndarray:
        """Lists in the order in which queries probe them."""
        return np.argsort(-(q @ self.centres.T), axis=1, kind="stable")

    def thresholds(self, q: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        """The 2 k-th best of the sample for each query, its own id left out."""
        if len(self.sample) <= 2 * k:
            return np.full(len(q), -np.inf)
        out = np.empty(len(q))
        for a in range(0, len(q), 64):
            scores = q[a:a + 64] @ self.sample.T
            scores[ids[a:a + 64, None] == self.sample_ids[None, :]] = -np.inf
            out[a:a + 64] = np.partition(scores, scores.shape[1] - 2 * k, axis=1)[:, -2 * k]
        return out


def fit_index(sample: np.ndarray, ids: np.ndarray, rows: int, rounds: int = 8, seed: int = 11) -> Index:
    rng = np.random.default_rng(seed)
    width = sample.shape[1]
    rotation = np.linalg.qr(rng.standard_normal((width, width)))[0]
    many = int(max(1, min(round(rows**0.5), len(sample) // 16 or 1)))
    centres = sample[np.sort(rng.choice(len(sample), many, replace=False))].copy()
    index = Index(rotation, centres, sample, ids)
    for _ in range(rounds):
        near = index.lists(sample)
        counts = np.bincount(near, minlength=many)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        full = counts > 0
        index.centres[full] = sums[full] / counts[full, None]
    return index


def valid_vectors(table: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles): rows that take part."""
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = usable.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda v: v != 0))
    return usable.dropDuplicates(["vec_id", "embedding"])


def scan(q: np.ndarray, q_ids: np.ndarray, limits: np.ndarray, x: np.ndarray, x_ids: np.ndarray, rotation: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (its place): places of its best candidates that reach the limit, and their
    scores. Candidates come in runs; a full set of k raises the limit for the next run."""
    width = x.shape[1]
    turned_x, turned_q = x @ rotation, q @ rotation
    edges = list(range(0, width, COLUMNS)) + [width]
    stored = [np.ascontiguousarray(turned_x[:, a:b]) for a, b in zip(edges, edges[1:])]
    x_rest = np.sqrt(np.cumsum((turned_x**2)[:, ::-1], axis=1)[:, ::-1])
    q_rest = np.sqrt(np.cumsum((turned_q**2)[:, ::-1], axis=1)[:, ::-1])
    first = turned_q[:, :edges[1]] @ stored[0].T
    for row in range(len(q)):
        limit, kept, scores = limits[row], np.zeros(0, int), np.zeros(0)
        slack = ROUNDING * q_rest[row, 0] * x_rest[:, 0]
        for run in range(0, len(x), RUN):
            alive = np.arange(run, min(run + RUN, len(x)))
            partial = first[row, alive]
            for b in range(1, len(stored)):
                seen = edges[b]
                if np.isfinite(limit):
                    length = q_rest[row, 0] * x_rest[alive, 0]
                    deviation = np.sqrt((1 - seen / width) / seen * (length**2 + limit**2))
                    fits = (partial * (width / seen) + DOUBT * deviation >= limit) & (partial + q_rest[row, seen] * x_rest[alive, seen] >= limit - slack[alive])
                    alive, partial = alive[fits], partial[fits]
                partial = partial + stored[b][alive] @ turned_q[row, seen:edges[b + 1]]
            alive = alive[(partial >= limit - slack[alive]) & (x_ids[alive] != q_ids[row])]
            kept, scores = np.append(kept, alive), np.append(scores, exact_scores(x[alive], q[row]))
            top = best(scores, x_ids[kept], k)
            kept, scores = kept[top], scores[top]
            if len(kept) == k:
                limit = max(limit, scores[-1])
        yield row, kept, scores


def scanner(index, width: int, k: int) -> Callable:
    def unit(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[np.ndarray] = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(queries) and len(rows):
            q, q_ids = matrix(queries.column("embedding"), width), queries.column("vec_id").to_numpy()
            x, x_ids = matrix(rows.column("embedding"), width), rows.column("vec_id").to_numpy()
            limits = queries.column("limit").to_numpy()
            for row, places, scores in scan(q, q_ids, limits, x, x_ids, index.value.rotation, k):
                out[0].append(np.full(len(places), q_ids[row]))
                out[1].append(x_ids[places])
                out[2].append(scores)
        return pa.table({"query_id": np.concatenate(out[0]), "vec_id": np.concatenate(out[1]), "score": np.concatenate(out[2])})
    return unit


def top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_neighbours(vectors: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """The true neighbours of few given queries: every batch of vectors keeps its k best."""
    given = vectors.sparkSession.sparkContext.broadcast((ids, q))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = given.value
        for batch in batches:
            x, x_ids = matrix(batch.column("embedding"), q.shape[1]), batch.column("vec_id").to_numpy()
            for row in range(len(q)):
                others = np.flatnonzero(x_ids != q_ids[row])
                kept, scores = top_exact(x[others], x_ids[others], q[row], k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), q_ids[row])), pa.array(x_ids[others][kept]), pa.array(scores)], ["query_id", "vec_id", "score"])

    return top(vectors.mapInArrow(compare, FOUND), k)


def build_index(vectors: DataFrame, queries: Column, k: int, recall: float) -> tuple[Index, int] | None:
    """Index and vector length; ``vectors`` is a stored table of valid vectors of one length."""
    rows = vectors.count()
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    trials = vectors.filter(queries).orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(TRIALS).toArrow()
    if not len(sample) or not len(trials):
        return None
    width = len(sample.column("embedding")[0])
    index = fit_index(matrix(sample.column("embedding"), width), sample.column("vec_id").to_numpy(), rows)
    q_ids, q = trials.column("vec_id").to_numpy(), matrix(trials.column("embedding"), width)
    truth = exact_neighbours(vectors, q_ids, q, k).join(vectors, "vec_id").select("query_id", "embedding").toArrow()
    place = np.argsort(index.order(q), axis=1)  # of each list in each query's order
    row_of = {int(v): i for i, v in enumerate(q_ids)}
    reached = np.sort([place[row_of[int(a)], b] for a, b in zip(truth.column("query_id").to_numpy(), index.lists(matrix(truth.column("embedding"), width)))])
    index.probes = int(reached[min(len(reached) - 1, int(np.ceil(recall * len(reached))))]) + 1 if len(reached) else len(index.centres)
    return index, width


def nearest_neighbours(table: DataFrame, queries: Column, k: int = 20, recall: float = 0.97) -> DataFrame:
    """query_id, rank, vec_id, score of the rows for which ``queries`` (a condition on vec_id)
    holds, among all others of ``table`` (vec_id, embedding)."""
    spark = table.sparkSession
    ship_package(spark)
    vectors = durable(valid_vectors(table), "vectors")
    lengths = vectors.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if lengths is None:
        return none
    vectors = vectors.filter(F.size("embedding") == lengths["n"])
    built = build_index(vectors, queries, k, recall)
    if built is None:
        return none
    index, width = built
    shared = spark.sparkContext.broadcast(index)

    def to_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = shared.value.lists(matrix(batch.column("embedding"), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], [*batch.schema.names, "list"])

    listed = durable(vectors.select("vec_id", "embedding").mapInArrow(to_lists, "vec_id long, embedding array<double>, list int"), "lists")
    sizes = listed.groupBy("list").agg(F.count("*").alias("rows")).select("list", F.ceil(F.col("rows") / LIST_BLOCK).cast("int").alias("blocks"))
    asked = vectors.filter(queries)

    def to_probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            q = matrix(batch.column("embedding"), width)
            order = model.order(q)[:, :model.probes]
            limits = model.thresholds(q, batch.column("vec_id").to_numpy(), k)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, order.size + 1, order.shape[1]), pa.int32()), pa.array(order.astype(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(limits), lists], [*batch.schema.names, "limit", "lists"])

    probing = asked.select("vec_id", "embedding").mapInArrow(to_probes, "vec_id long, embedding array<double>, limit double, lists array<int>")
    probing = probing.select("vec_id", "embedding", "limit", F.explode("lists").alias("list"))
    crowd = probing.groupBy("list").agg(F.count("*").alias("queries")).select("list", F.ceil(F.col("queries") / QUERY_BLOCK).cast("int").alias("query_blocks"))
    # both sides' numbers of blocks: a row per list, at most SAMPLE / 16 of them
    units = durable(sizes.join(crowd, "list"), "units")

    def block(count: str, salt: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(count)).cast("int")

    q = probing.join(F.broadcast(units), "list").select(
        "vec_id", "embedding", "limit", "list", block("query_blocks", 1).alias("qb"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("xb"))
    x = listed.join(F.broadcast(units), "list").select(
        "vec_id", "embedding", "list", block("blocks", 2).alias("xb"), F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("qb"))
    keys = ["list", "qb", "xb"]
    found = q.groupBy(*keys).cogroup(x.groupBy(*keys)).applyInArrow(scanner(shared, width, k), FOUND)
    found = durable(top(found, k), "found")

    def from_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            q, q_ids = matrix(batch.column("embedding"), width), batch.column("vec_id").to_numpy()
            for row in range(len(q)):
                others = np.flatnonzero(model.sample_ids != q_ids[row])
                kept, scores = top_exact(model.sample[others], model.sample_ids[others], q[row], k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), q_ids[row])), pa.array(model.sample_ids[others][kept]), pa.array(scores)], ["query_id", "vec_id", "score"])

    enough = found.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    more = asked.join(enough, "vec_id", "left_anti").select("vec_id", "embedding").mapInArrow(from_sample, FOUND)
    both = found.select("query_id", "vec_id", "score").unionByName(more).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return top(both, k)
