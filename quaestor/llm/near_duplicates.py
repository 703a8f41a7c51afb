"""MinHash near-duplicate detection with min-max signatures.

Under each permutation of the shingle hashes both the smallest and the largest value of a set
are kept, so ``values`` signature entries take ``values / 2`` hash evaluations per shingle; both
are fair samples of the union, and two sets agree in either with the probability of their
resemblance. Entries are dealt into bands by a fixed shuffle. With the defaults (24 bands of 5
entries) a pair at resemblance 0.85 shares no band with probability 7e-7.

Steps, none of which holds a whole group in one task:

1. One pass over the texts gives per document its number of distinct shingles, a digest of the
   set and the band hashes. Documents of one digest form a class; only classes go on, so copies
   of one text, however many, are one node.
2. Classes that share a band hash form a bucket; buckets of equal members are taken once. A
   bucket is dealt into blocks of bounded size and every pair of blocks is one unit of work,
   so a bucket of any size is compared completely and no task grows with it.
3. A unit compares the full sets of its members and returns a spanning forest of the links.
4. Classes and links give components by alternating large-star and small-star rounds, stored
   between rounds; a component is named by its smallest document id.

Rows without words (null and empty texts too) are linked with nothing. Rows with a null id take
part in no group: their component is null and they are kept. Repeated rows share a component and
are kept or not together. Other input columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.words import mix, shingle_sets
from quaestor.session import durable, ship_package

BLOCK_ROWS = 512
BLOCK_SHINGLES = 1 << 20
SEED = 20240229
PROFILE = "doc_id long, n_shingles long, node long, bands array<long>"


def _permutations(values: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    half = (values + 1) // 2
    factors = rng.integers(0, 1 << 63, half, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 63, half, dtype=np.uint64)
    return factors, shifts, rng.permutation(2 * half)[:values]


def min_max_signatures(sets: np.ndarray, offsets: np.ndarray, values: int) -> np.ndarray:
    """One row per set: the minima and maxima under values / 2 permutations, in shuffled order.
    Empty sets get zeros."""
    factors, shifts, order = _permutations(values)
    half = len(factors)
    out = np.zeros((len(offsets) - 1, 2 * half), np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    at = offsets[:-1][full]
    if len(full):
        for k in range(half):
            permuted = sets * factors[k] + shifts[k]
            out[full, k] = np.minimum.reduceat(permuted, at)
            out[full, half + k] = np.maximum.reduceat(permuted, at)
    return out[:, order]


def band_hashes(signatures: np.ndarray, bands: int) -> np.ndarray:
    cells = signatures.reshape(len(signatures), bands, -1)
    hashed = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), cells.shape[:2]).copy()
    for k in range(cells.shape[2]):
        hashed = mix(hashed ^ cells[:, :, k]) + np.uint64(k)
    return hashed


def set_digests(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One number per set, whatever the order of its members."""
    sums = np.zeros(len(sets) + 1, np.uint64)
    np.cumsum(mix(sets), out=sums[1:])
    return mix(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(np.uint64)).view(np.int64)


def profiler(width: int, bands: int, rows: int) -> Callable:
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for row, sets, offsets in shingle_sets(batch.column("text"), width):
                n, node = np.diff(offsets), set_digests(sets, offsets)
                hashed = band_hashes(min_max_signatures(sets, offsets, bands * rows), bands)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, hashed.size + 1, bands), pa.int32()), pa.array(hashed.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, len(n)).cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(node), lists],
                    ["doc_id", "n_shingles", "node", "bands"])
    return profile


def profiles(docs: DataFrame, width: int = 5, bands: int = 24, rows: int = 5) -> DataFrame:
    """doc_id, n_shingles, node (digest of the shingle set), bands, one row per document."""
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(profiler(width, bands, rows), PROFILE)


def set_maker(width: int) -> Callable:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets, offsets in shingle_sets(batch.column("text"), width):
                packed = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(offsets) - 1,
                    [None, pa.py_buffer((offsets * 8).astype(np.int64).tobytes()), pa.py_buffer(sets.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(set_digests(sets, offsets)), packed.cast(pa.binary())], ["node", "shingles"])
    return make


def forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Those of the given edges that join two trees."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in zip(left.tolist(), right.tolist()):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[rb] = ra
            kept.append((a, b))
    return kept


def shared_counts(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections, as products of 0/1 matrices over the shingles that
    occur in more than one set, a block of columns at a time."""
    sizes = np.array([len(s) for s in sets])
    rows = np.repeat(np.arange(len(sets)), sizes)
    values, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1
    several = counts[column] > 1
    rows, column = rows[several], number[column[several]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    total = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, total, columns):
        lo, hi = np.searchsorted(column, [start, start + columns])
        present = np.zeros((len(sets), min(columns, total - start)), np.float32)
        present[rows[lo:hi], column[lo:hi] - start] = 1
        shared += present @ present.T
    return np.rint(shared).astype(np.int64)


def comparer(percent: int) -> Callable:
    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node").sort_values("node")
        nodes = group["node"].to_numpy()
        edges: list[tuple[int, int]] = []
        if len(nodes) > 1:
            sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
            shared = shared_counts(sets)
            sizes = np.array([len(s) for s in sets])
            union = sizes[:, None] + sizes[None, :] - shared
            left, right = np.nonzero(np.triu(100 * shared >= percent * union, 1))
            edges = forest(len(nodes), left, right)
        return pd.DataFrame({"a": nodes[[a for a, _ in edges]], "b": nodes[[b for _, b in edges]]}, dtype="int64")
    return compare


def bucket_members(classes: DataFrame) -> DataFrame:
    """bucket, node, n_shingles: all members of every bucket of two or more classes; of buckets
    with the same members (seen as equal sums of mixed ids) one is taken."""
    cells = classes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    buckets = cells.groupBy("bucket").agg(
        F.count("*").alias("members"), F.sum("n_shingles").alias("weight"),
        F.bit_xor(F.xxhash64("node")).alias("mark"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("mark2"))
    several = buckets.filter("members > 1").groupBy("members", "weight", "mark", "mark2").agg(F.min("bucket").alias("bucket"))
    return cells.join(several.select("bucket", "members", "weight"), "bucket")


def links(docs: DataFrame, profiled: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: edges between classes that span all groups of linked classes."""
    named = profiled.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = named.groupBy("node").agg(
        F.max("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.min("doc_id").alias("doc_id"))
    members = durable(bucket_members(classes), "members")
    # any text of a class has the class's shingles: that of its smallest id is read again
    wanted = members.select("node").distinct().join(classes.select("node", "doc_id"), "node").select("doc_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    chosen = texts.join(wanted, "doc_id").select("text")
    sets = chosen.mapInArrow(set_maker(width), "node long, shingles binary")
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK_ROWS), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int")
    placed = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    units = placed.select(
        "node", "bucket",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(
            F.least(other, F.col("block")).alias("low"), F.greatest(other, F.col("block")).alias("high")))).alias("pair"),
    ).select("node", "bucket", "pair.low", "pair.high")
    return units.join(sets, "node").groupBy("bucket", "low", "high").applyInPandas(comparer(percent), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: every node of the undirected edges (columns a, b) with the smallest node it
    can reach. Large-star and small-star rounds alternate until nothing changes."""
    spark = edges.sparkSession

    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", F.lit(3), "a"))).first())

    current = durable(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = state(current)
    while before[0]:
        seen = both(current)
        lowest = seen.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = seen.join(lowest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        down = large.filter("a > b")
        lowest = down.groupBy("a").agg(F.min("b").alias("low"))
        small = down.join(lowest, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct(F.col("a"), F.col("low").alias("b")))).alias("e")).select("e.a", "e.b")
        current = durable(small.filter("a > b").distinct(), "links")
        after = state(current)
        if after == before:
            break
        before = after
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")) if before[0] else spark.createDataFrame([], "node long, root long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 24, rows: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Two documents are linked when 100 * |intersection| >= percent * |union| of their sets of
    distinct ``width``-word shingles; a component is all that links reach.
    """
    profiled = durable(profiles(docs, width, bands, rows), "profiles")
    roots = components(links(docs, profiled, width, percent))
    linked = profiled.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = linked.groupBy("node").agg(F.min("doc_id").alias("low"))
    rooted = durable(classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "classes")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component"))
    named = rooted.join(lowest, "root").select("node", "component")
    alone = F.col("n_shingles") == 0
    # rows that no group can hold are set apart, so that they don't meet under one key
    grouped = profiled.filter("n_shingles > 0 AND doc_id IS NOT NULL").join(named, "node").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    rest = profiled.filter(alone | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return grouped.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
