"""Index of stored keys, read by buckets.

A stored question has a digest and perhaps a code; a batch must know which of its own are stored
already without reading all of them. Keys lie in segments. The newest are the stored rows of
recent batches as they are; ``FANOUT`` segments of a level are merged into one of the next level,
so there are a few for each power of ``FANOUT``. A merged segment is cut by a hash of the key
into a power of two of buckets, a folder each, of about ``BUCKET_ROWS`` keys. A batch reads, of each
segment, only the buckets its own keys fall into: what it reads depends on its own size and on the
number of segments, not on the size of the bank.

The list of live segments is part of the commit of a batch; a segment that no commit names is not
seen. Merging happens before a commit, so a crash in between leaves the old list in force.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FANOUT = 8
BUCKET_ROWS = 4_096
#: of a segment in a commit
SEGMENT = "struct<path:string,level:int,rows:bigint,bits:int,empty:array<int>>"


@dataclass(frozen=True)
class Segment:
    """``level`` 0: the folder of a batch's stored rows; above: keys in ``2**bits`` buckets, those in
    ``empty`` without a folder."""

    path: str
    level: int
    rows: int
    bits: int = 0
    empty: list[int] = field(default_factory=list)

    def as_row(self) -> dict:
        return asdict(self)


def keys_of(rows: DataFrame) -> DataFrame:
    """``k`` of rows with hash_enunciado and id_qc: one key for the digest, one for a code."""
    both = F.array(F.concat(F.lit("d"), "hash_enunciado"), F.concat(F.lit("c"), "id_qc"))
    return rows.select(F.explode(both).alias("k")).filter("k is not null")


def bucket(key: Column | str, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << bits)).cast("int")


def write_segment(keys: DataFrame, folder: str, rows: int, level: int) -> Segment:
    bits = max(0, (rows // BUCKET_ROWS).bit_length())
    path = f"{folder}/{uuid.uuid4().hex}"
    dealt = keys.withColumn("bucket", bucket("k", bits))
    (dealt.repartition("bucket") if bits else dealt.coalesce(1)).write.partitionBy("bucket").parquet(path)
    used = {r["bucket"] for r in keys.sparkSession.read.parquet(path).select("bucket").distinct().toLocalIterator()} if bits else {0}
    return Segment(path, level, rows, bits, sorted(set(range(1 << bits)) - used))


def first_segment(bank: DataFrame, folder: str) -> tuple[list[Segment], int]:
    """Index of a bank that was stored elsewhere, and its highest id."""
    totals = bank.agg(F.count("hash_enunciado"), F.count("id_qc"), F.coalesce(F.max("id"), F.lit(0))).first()
    rows, level = totals[0] + totals[1], 1
    while BUCKET_ROWS * FANOUT**level < rows:
        level += 1
    return [write_segment(keys_of(bank), folder, rows, level)] if rows else [], totals[2]


def _read(spark: SparkSession, segment: Segment, touched: set[int] | None) -> DataFrame | None:
    """Keys of a segment's buckets (``touched``; None: all)."""
    if not segment.level:
        return keys_of(spark.read.schema("hash_enunciado string, id_qc string").parquet(segment.path))
    mask = (1 << segment.bits) - 1
    wanted = set(range(mask + 1)) if touched is None else {b & mask for b in touched}
    paths = [f"{segment.path}/bucket={b}" for b in sorted(wanted - set(segment.empty))]
    return spark.read.schema("k string").parquet(*paths) if paths else None


def known_keys(spark: SparkSession, segments: list[Segment], asked: DataFrame) -> DataFrame:
    """``k`` of all stored keys that ``asked`` (k) could hold, and of others in the same buckets. Numbers
    of buckets come to the driver, at most one for each key asked."""
    bits = max((s.bits for s in segments), default=0)
    touched = {r["b"] for r in asked.select(bucket("k", bits).alias("b")).distinct().toLocalIterator()} if bits else {0}
    found = [part for s in segments if (part := _read(spark, s, touched)) is not None]
    out = spark.createDataFrame([], "k string")
    for part in found:
        out = out.unionByName(part)
    return out


def merged(spark: SparkSession, segments: list[Segment], folder: str) -> tuple[list[Segment], list[Segment]]:
    """(segments after every full level was merged into the next, those no longer needed)."""
    live, gone, level = list(segments), [], 0
    while level <= max((s.level for s in live), default=-1):
        mine = [s for s in live if s.level == level]
        if len(mine) >= FANOUT:
            parts = [part for s in mine if (part := _read(spark, s, None)) is not None]
            keys = parts[0]
            for part in parts[1:]:
                keys = keys.unionByName(part)
            rows = sum(s.rows for s in mine)
            live = [s for s in live if s.level != level] + [write_segment(keys, folder, rows, level + 1)]
            gone += [s for s in mine if s.level]  # level 0 is the bank itself
        level += 1
    return live, gone
