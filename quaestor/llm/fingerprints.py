"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the ascending list of the k smallest distinct hashes of a text's shingles. The
sketch of a union is the k smallest of both sketches, so sketches of parts merge to that of the
whole, in any order, and can be aggregated. From sketches alone follow estimates of resemblance,
containment and the number of distinct shingles; below k distinct shingles all are exact.

All are column expressions over built-in functions. Words are runs of characters other than
space and \\t \\n \\v \\f \\r, as they stand; a text shorter than ``width`` words is one shingle,
a text without words (null, empty) has an empty sketch. Two empty sketches resemble each other
fully, an empty and a full one not at all. Equal texts have equal sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.session import once

K = 128
WIDTH = 5
SPAN = float(2**64)


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(hashes: Column, width: int = WIDTH) -> Column:
    """Hashes of all runs of ``width`` of the given word hashes. ``hashes`` should be a stored
    column (see ``sketch_columns``), as it is read ``width`` times per shingle."""
    runs = F.transform(F.sequence(F.lit(0), F.size(hashes) - width), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))
    return F.when(F.size(hashes) >= width, runs).when(F.size(hashes) > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch_columns(frame: DataFrame, texts: dict[str, Column], width: int = WIDTH, k: int = K) -> DataFrame:
    """``frame`` with a sketch column for each of ``texts``."""
    frame = once(frame, **{f"_h_{name}": word_hashes(text) for name, text in texts.items()})
    frame = once(frame, **{name: bottom(shingles(F.col(f"_h_{name}"), width), k) for name in texts})
    return frame.drop(*[f"_h_{name}" for name in texts])


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return bottom(F.concat(a, b), k)


def merge_sketches(frame: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """One merged sketch per key: the k smallest distinct hashes, by a distinct-then-rank
    that Spark reduces in every task before it shuffles, so hot keys don't gather."""
    hashes = frame.select(*keys, F.explode(sketch).alias("_hash")).distinct()
    ranked = hashes.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_hash"))).filter(F.col("_rank") <= k)
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list("_hash")).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated |A and B| / |A or B|: the share of the union's sketch that both contain."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    reach = (F.element_at(a, -1).cast("double") + 2.0**63) / SPAN
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / reach)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated |A and B| / |A|: the share of A's hashes in B, as far as both sketches reach;
    null where A has none as far down as B's sketch reaches."""
    far = F.lit(2**63 - 1)
    reach = F.least(F.when(F.size(a) < k, far).otherwise(F.element_at(a, -1)), F.when(F.size(b) < k, far).otherwise(F.element_at(b, -1)))
    within = F.filter(a, lambda h: h <= reach)
    return F.when(F.size(a) == 0, F.lit(1.0)).when(F.size(within) > 0, F.size(F.array_intersect(within, b)) / F.size(within))


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")
