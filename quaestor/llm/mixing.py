"""Mixing sources to target weights by Sainte-Lague apportionment.

Each source is cut into shards of bounded size by a digest of the document's id and text, each shard into
blocks of nearly equal numbers of words along its documents in digest order. Sainte-Lague (seats
go to the highest quotients votes / (2 * seats + 1)) gives every source a whole number of blocks
from its target, then every shard of a source its share of those. A shard whose quota is q of n
blocks takes each block q div n times, and q mod n more of them by a seeded permutation, so no
document is taken more often than q / n rounded up.

Everything is DataFrame operations. Tables of sources have a row per source and are sorted in one
task, so their number should stay below some millions; windows over documents run over one shard,
never over a source, so a source that holds a third of all rows is spread over its shards. Equal rows
are folded before the windows and laid out again after them; rows without words take no part in them.

Null texts have size 0 and nothing is taken of them. Null sources form one source, after all
others. Null and repeated ids are rows like any other; rows equal in id, size and digest may change
places among themselves. Columns beside doc_id, text and source, whatever their names, are not
read. An empty table gives no rows.

``mix_documents`` carries the same quotas out in whole documents: each as often as the quota of
its shard holds all blocks, and the first in the shard's seeded order once more, until the rest
of the quota is met as nearly as a whole document allows. The choice does not depend on a document's
length, and rows of equal or null ids are placed by their text and chosen one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.session import durable

#: a prime above any number of blocks in a shard: steps by it visit every block once
STRIDE = 2654435761
#: equal rows that are handled as one
COPIES = 65_536
WORD = r"[^\x20\x09-\x0D]+"


def digest(*parts: Column) -> Column:
    """A whole number from 0 to 2**32 - 1, the same in every SQL engine: the head of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 8), 16, 10).cast("long")


def apportion(parties: DataFrame, group: list[str], party: list[str], votes: str, seats: str) -> DataFrame:
    """``parties`` with ``quota``: the group's ``seats`` by highest quotients, ties to the smaller party.

    Rounding with a divisor half a seat per party too large or too small brackets every party's
    result, so only the quotients in between, about three per party, are ranked.
    """
    whole = Window.partitionBy(*group)
    v, t = F.col(votes).cast("double"), F.col(seats)
    frame = parties.withColumn("_all", F.sum(v).over(whole)).withColumn("_m", F.count("*").over(whole) / 2)

    def rounded(total: Column) -> Column:
        return F.when(F.col("_all") > 0, F.floor(v * F.greatest(total, F.lit(0.0)) / F.col("_all") + 0.5)).otherwise(0)

    frame = (frame.withColumn("_low", F.greatest(rounded(t - F.col("_m")) - 1, F.lit(0)).cast("long"))
             .withColumn("_high", F.when(v > 0, rounded(t + F.col("_m")) + 1).otherwise(0).cast("long")))
    frame = frame.withColumn("_left", t - F.sum("_low").over(whole))
    tries = frame.filter("_high > _low").select(
        *group, *party, "_left", v.alias("_v"), F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)).alias("_s"))
    order = Window.partitionBy(*group).orderBy(F.desc(F.col("_v") / (2 * F.col("_s") + 1)), *party)
    won = tries.withColumn("_rank", F.row_number().over(order)).filter("_rank <= _left").groupBy(*group, *party).agg(F.count("*").alias("_won"))
    keys = list(dict.fromkeys(group + party))
    return (frame.join(won, keys, "left").withColumn("quota", F.col("_low") + F.coalesce("_won", F.lit(0)))
            .drop("_all", "_m", "_low", "_high", "_left", "_won"))


def source_targets(sizes: DataFrame, weights: list[int], share: float, most: int) -> DataFrame:
    """One row per source with ``target``: ``share`` of all sizes dealt by weight, stopping at
    ``most`` times the source's size, the excess dealt again until none is above.

    In the order of size / weight the sources at their limit come first. The level that each
    source would see if all before it were at their limit rises over those and falls after
    them, so its greatest value is the level at which the dealing ends.
    """
    everything = Window.partitionBy("one")
    ordered = sizes.withColumn("one", F.lit(1)).withColumn("_n", F.row_number().over(
        everything.orderBy(F.col("source").isNull(), F.col("source"))))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("_n") - 1, F.lit(len(weights))) + 1).cast("int"))
    ordered = ordered.withColumn("weight", weight).withColumn("_limit", F.col("source_size") * most)
    by_limit = everything.orderBy(F.col("_limit") / F.col("weight"), "_n").rowsBetween(Window.unboundedPreceding, -1)
    from_here = everything.orderBy(F.col("_limit") / F.col("weight"), "_n").rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(share)
    level = (total - F.coalesce(F.sum("_limit").over(by_limit), F.lit(0))) / F.sum("weight").over(from_here)
    return (ordered.withColumn("_level", level.cast("double")).withColumn("_level", F.max("_level").over(everything))
            .withColumn("target", F.least(F.col("_limit").cast("double"), F.col("weight") * F.col("_level")))
            .select("key", "source", "source_size", "weight", "target"))


def on_shards(sized: DataFrame, targets: DataFrame) -> DataFrame:
    return sized.join(targets.select("key", "source_size", "target", "shards"), "key").withColumn("shard", F.pmod("place", "shards"))


def shard_quotas(sized: DataFrame, weights: list[int] | None, share: float, most: int, block_words: int, shard_words: int) -> tuple[DataFrame, DataFrame]:
    """Stored tables of targets by source, and of words, blocks and quotas by shard, from a stored
    table of key, source, size, place."""
    sizes = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights or [1, 2, 3], share, most)
    targets = durable(targets.withColumn("shards", F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("long")), "targets")

    words = on_shards(sized, targets).groupBy("key", "shard").agg(F.sum("size").alias("words"))
    words = words.withColumn("blocks", F.when(F.col("words") > 0, F.greatest(F.round(F.col("words") / block_words), F.lit(1))).otherwise(0).cast("long"))
    words = durable(words, "shards")
    blocks = words.groupBy("key").agg(F.sum("blocks").alias("blocks"))
    ballots = targets.join(blocks, "key").select(
        F.lit(1).alias("one"), "key", "blocks",
        F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0).alias("votes"))
    ballots = ballots.withColumn("seats", F.round(F.sum("votes").over(Window.partitionBy("one"))).cast("long"))
    quotas = apportion(ballots, ["one"], ["key"], "votes", "seats").select("key", F.least("quota", F.col("blocks") * most).alias("seats"))
    shards = apportion(words.join(quotas, "key"), ["key"], ["shard"], "blocks", "seats")
    return targets, durable(shards.select("key", "shard", "words", "blocks", "quota"), "quotas")


def source_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))


def word_count() -> Column:
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def folded(sized: DataFrame) -> DataFrame:
    """Rows of ``sized`` (doc_id, source, key, size, place) that are equal in all of these as one, cut to at most
    ``COPIES``: ``copies`` rows of ``each`` words, ``size`` together. Of the rows without words there is one
    for each source."""
    same = sized.filter("size > 0").groupBy("doc_id", "source", "key", "size", "place").agg(F.count("*").alias("n"))
    parts = same.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))).alias("part"))
    copies = F.least(F.col("n") - F.col("part") * COPIES, F.lit(COPIES))
    full = parts.select("doc_id", "source", "key", F.col("size").alias("each"), copies.alias("copies"),
                        (F.col("size") * copies).alias("size"), (F.col("place") + F.col("part")).alias("place"))
    none = sized.filter("size = 0").groupBy("source", "key").agg(F.count("*").alias("copies"))
    zero = F.lit(0).cast("long")
    return full.unionByName(none.select("source", "key", "copies", zero.alias("each"), zero.alias("size"), zero.alias("place")), allowMissingColumns=True)


def mix_sources(docs: DataFrame, weights: list[int] | None = None, share: float = 1.0, most: int = 3,
                block_words: int = 64, shard_words: int = 1 << 18, seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs`` (doc_id, text, source)."""
    every = durable(docs.select(
        "doc_id", "source", source_key().alias("key"), word_count().alias("size"),
        digest(F.lit(seed), F.col("doc_id"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("place")), "sizes")
    sized = durable(folded(every), "folded")
    targets, shards = shard_quotas(sized, weights, share, most, block_words, shard_words)
    placed = on_shards(sized.filter("size > 0"), targets)

    stream = Window.partitionBy("key", "shard").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    spans = (placed.withColumn("end", F.sum("size").over(stream)).withColumn("start", F.col("end") - F.col("size"))
             .join(shards, ["key", "shard"]).withColumn("shift", digest(F.lit(seed), F.col("key"), F.col("shard"))))
    # equal rows lie one after the other
    spans = spans.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    spans = spans.withColumn("start", F.col("start") + F.col("copy") * F.col("each")).withColumn("end", F.col("start") + F.col("each"))

    def block_at(position: Column) -> Column:
        return F.floor(((position + 1) * F.col("blocks") - 1) / F.col("words")).cast("long")

    def overlap(j: Column) -> Column:
        low, high = F.floor(j * F.col("words") / F.col("blocks")), F.floor((j + 1) * F.col("words") / F.col("blocks"))
        chosen = F.pmod(j * STRIDE + F.col("shift"), F.col("blocks")) < F.pmod("quota", "blocks")
        return F.when(chosen, F.least(F.col("end"), high) - F.greatest(F.col("start"), low)).otherwise(0).cast("long")

    more = F.aggregate(F.sequence(block_at(F.col("start")), block_at(F.col("end") - 1)), F.lit(0).cast("long"), lambda n, j: n + overlap(j))
    taken = F.floor(F.col("quota") / F.col("blocks")).cast("long") * F.col("each") + more
    counted = spans.select("doc_id", F.col("each").alias("size"), "source_size", "target", taken.cast("long").alias("taken"))
    without = every.filter("size = 0").join(targets.select("key", "source_size", "target"), "key")
    return counted.unionByName(without.select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))


def mix_documents(docs: DataFrame, weights: list[int] | None = None, share: float = 1.0, most: int = 3,
                  block_words: int = 64, shard_words: int = 1 << 20, seed: int = 1) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it: none, once or up to
    ``most`` times. A shard's words miss its quota by half a document at most."""
    place = digest(F.lit(seed), F.col("doc_id"), F.xxhash64("text"))
    measured = docs.select(F.struct(*docs.columns).alias("row"), "source", source_key().alias("key"), word_count().alias("size"), place.alias("place"))
    sized = durable(measured.drop("row"), "sizes")
    targets, shards = shard_quotas(sized, weights, share, most, block_words, shard_words)
    # the texts meet their shard's quota and its order in one exchange
    stream = Window.partitionBy("key", "shard").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = on_shards(measured.filter("size > 0"), targets).join(shards, ["key", "shard"]).withColumn("end", F.sum("size").over(stream))
    rest = F.col("words") * F.pmod("quota", "blocks") / F.col("blocks")
    once_more = (F.col("end") - F.col("size") / 2 < rest).cast("int")
    times = F.floor(F.col("quota") / F.col("blocks")).cast("int") + once_more
    chosen = placed.withColumn("times", times).filter("times > 0")
    return chosen.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select("row.*")
