"""Inverted index of statements, for searches that don't read the statements.

A row lists for a term and a block of ``BLOCK_IDS`` ids the questions that have the term, with how
often (postings), and beside the lists their length and the largest count (the block maximum). A
search that wants only these reads no list. Rows lie in ``BUCKETS`` folders by a hash of the term,
sorted by term and block, so a search reads a few files and of these only the parts that can hold
its terms. A search for the best k scores a few blocks of the highest sums of maxima first and then
reads only blocks whose sum reaches the k-th score found, which cannot lose a result. New questions
are appended as new files with ids of their own, each id once; a term may have several rows for a
block, as tasks list ``PART_ROWS`` statements at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.functions import text
from quaestor.session import durable, ship_package

BUCKETS = 64
BLOCK_IDS = 16_384
FIRST_BLOCKS = 4
# statements are dealt to tasks by stripes of ids and listed some at a time; a bucket is one file per so many
STRIPE_IDS = 4_096
PART_ROWS = 4_096
FILE_ROWS = 131_072
LISTS = "term string, block long, most long, n long, ids array<long>, tfs array<long>"


def _bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def list_terms(block_ids: int, part: int):
    """Arrow batches of ``id, norm`` (blank-separated words) to batches of ``LISTS``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, part):
                piece = batch.slice(start, part)
                ids, rows = np.unique(piece.column("id").to_numpy(), return_inverse=True)
                words = pc.split_pattern(piece.column("norm"), " ")
                terms = pc.list_flatten(words).dictionary_encode()
                keys = terms.indices.to_numpy().astype(np.int64) * len(ids) + rows[pc.list_parent_indices(words).to_numpy()]
                keys, tfs = np.unique(keys, return_counts=True)  # by term and id
                codes, rows = np.divmod(keys, len(ids))
                blocks = ids[rows] // block_ids
                first = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])])
                ends = pa.array(np.r_[first, len(keys)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [terms.dictionary.take(pa.array(codes[first])), pa.array(blocks[first]), pa.array(np.maximum.reduceat(tfs, first)),
                     pa.array(np.diff(first, append=len(keys))), pa.ListArray.from_arrays(ends, pa.array(ids[rows])), pa.ListArray.from_arrays(ends, pa.array(tfs))],
                    ["term", "block", "most", "n", "ids", "tfs"])
    return run


def lists_of(questions: DataFrame) -> DataFrame:
    """``LISTS`` and bucket of every word of every statement, cut as ``draw.search_text`` cuts."""
    ship_package(questions.sparkSession)
    # statements of near ids meet in a task, so that a term has few rows for a block
    dealt = questions.filter("enunciado IS NOT NULL").select("id", "enunciado").repartition(F.floor(F.col("id") / STRIPE_IDS))
    words = dealt.select("id", text.normalize_text("enunciado").alias("norm"))
    return words.mapInArrow(list_terms(BLOCK_IDS, PART_ROWS), LISTS).withColumn("bucket", _bucket("term"))


def append_index(questions: DataFrame, path: str) -> None:
    """Index ``questions`` (id, enunciado) beside what ``path`` holds."""
    # a bucket is cut by blocks, so that no task's rows grow with the questions or with a frequent term
    cuts = max(1, -(-questions.count() // FILE_ROWS))
    dealt = lists_of(questions).repartitionById(BUCKETS * cuts, (F.col("bucket") * cuts + F.pmod("block", F.lit(cuts))).cast("int"))
    dealt.sortWithinPartitions("bucket", "term", "block").write.mode("append").partitionBy("bucket").parquet(f"{path}/lists")


def _of_terms(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """The lists of the terms, from their buckets alone (partition and pushed filters)."""
    numbers = list(spark.range(1).select(F.array(*[_bucket(F.lit(t)) for t in terms])).first()[0])
    return spark.read.schema(f"{LISTS}, bucket int").parquet(f"{path}/lists").filter(F.col("bucket").isin(numbers) & F.col("term").isin(terms))


def _scored(lists: DataFrame, terms: list[str]) -> DataFrame:
    """id, score of the questions with every term."""
    postings = lists.select(F.inline(F.arrays_zip("ids", "tfs"))).toDF("id", "tf")
    found = postings.groupBy("id").agg(F.count("*").alias("terms"), F.sum("tf").cast("int").alias("score"))
    return found.filter(F.col("terms") == len(terms)).select("id", "score")


def search_index(spark: SparkSession, path: str, terms: list[str], top: int | None = None) -> DataFrame:
    """``id, score`` of questions whose statement has every term as a word; ``score`` counts their
    occurrences. ``top`` keeps the best, ties by id."""
    terms = sorted({t.lower() for t in terms})
    lists = _of_terms(spark, path, terms)
    if top is None:
        return _scored(lists, terms)
    maxima = lists.groupBy("term", "block").agg(F.max("most").alias("most"))
    bounds = durable(maxima.groupBy("block").agg(F.count("*").alias("terms"), F.sum("most").alias("bound")).filter(F.col("terms") == len(terms)), "bounds")
    first = bounds.orderBy(F.desc("bound"), "block").limit(FIRST_BLOCKS).select("block")
    best = _scored(lists.join(F.broadcast(first), "block", "left_semi"), terms).orderBy(F.desc("score"), "id").limit(top)
    least = best.agg(F.count("*").alias("n"), F.min("score").alias("s")).first()
    reached = bounds.filter(F.col("bound") >= least["s"]) if least["n"] >= top else bounds
    return _scored(lists.join(reached.select("block"), "block", "left_semi"), terms).orderBy(F.desc("score"), "id").limit(top)
