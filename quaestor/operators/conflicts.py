"""First-wins under two unique keys in few rounds.

A row is accepted unless an earlier accepted row has its code or its digest. Rows are ``s`` (unique
order), ``c`` (code, may be NULL), ``d`` (digest), each pair of keys once. What can be decided in
parallel is: a row that is first under both keys is accepted, and rows sharing a key with an
accepted one are not. Alone, such rounds follow a chain of rows blocking each other two rows at a
time. Two more steps cut that short:

* **Chains.** A row with exactly one earlier undecided rival is accepted if and only if that rival is
  not. Such rows form chains; every row learns the head of its chain and whether it is an even
  number of steps away by doubling the distance it looks back, so a chain of n rows takes log n steps.
* **Components.** Rows that reach each other by shared keys form a component, and components don't
  touch. Those of at most ``TASK_ROWS`` rows are decided one after the other inside a task, all of
  them in one pass. Larger ones go on in rounds and chains; nothing is ever cut off.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.session import durable

#: rows that one task decides one by one
TASK_ROWS = 100_000


def without_codes(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Rows whose code ``c`` is not among ``codes``. Rows without a code are set apart, so that
    they don't meet under one key."""
    coded = rows.filter("c is not null").join(codes.filter("c is not null").select("c"), "c", "left_anti")
    return coded.unionByName(rows.filter("c is null"))


def firsts(pending: DataFrame) -> DataFrame:
    """Rows that are the earliest under both their keys."""
    by_digest = pending.groupBy("d").agg(F.min(F.struct("s", "c")).alias("m")).select("d", "m.s", "m.c")
    by_code = pending.filter("c is not null").groupBy("c").agg(F.min("s").alias("s"))
    return by_digest.filter("c is null").unionByName(
        by_digest.filter("c is not null").join(by_code, ["c", "s"], "left_semi").select("d", "s", "c"))


def settled(pending: DataFrame, winners: DataFrame, rejected: DataFrame | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Stored (winners, rows still pending, number of those) once ``winners`` are accepted and
    ``rejected`` (s) are not."""
    left = without_codes(pending.join(winners.select("d"), "d", "left_anti"), winners)
    if rejected is not None:
        left = left.join(rejected.select("s"), "s", "left_anti")
    columns = ["s", "c", "d"]
    state = durable(winners.select(*columns, F.lit(True).alias("won")).unionByName(left.select(*columns, F.lit(False).alias("won"))), "round")
    return state.filter("won").drop("won"), state.filter("not won").drop("won"), state.filter("not won").count()


# --- chains ---------------------------------------------------------------------------------

def rivals(pending: DataFrame) -> DataFrame:
    """s, c, d, earlier (how many of the two keys have an earlier row, 2 also where one key has more
    than one), rival (the earlier row where there is exactly one)."""
    def places(rows: DataFrame, key: str) -> DataFrame:
        """The two earliest rows of each key, as aggregates: a key may hold many rows."""
        one = rows.groupBy(key).agg(F.min("s").alias("one"))
        rest = rows.join(one, key).filter("s > one")
        two = rest.groupBy(key).agg(F.min("s").alias("two"))
        return one.join(two, key, "left")

    by_digest = places(pending, "d").select("d", F.col("one").alias("d1"), F.col("two").alias("d2"))
    coded = pending.filter("c is not null")
    by_code = places(coded, "c").select("c", F.col("one").alias("c1"), F.col("two").alias("c2"))
    rows = coded.join(by_code, "c").select("s", "c", "d", "c1", "c2").unionByName(
        pending.filter("c is null").select("s", "c", "d"), allowMissingColumns=True).join(by_digest, "d")

    def earlier(first: str, second: str):
        at = F.when(F.col(first).isNull() | (F.col("s") == F.col(first)), 0)
        return at.when(F.col("s") == F.col(second), 1).otherwise(2)

    rows = rows.withColumns({"_by_code": earlier("c1", "c2"), "_by_digest": earlier("d1", "d2")})
    alone = F.col("_by_code") + F.col("_by_digest") == 1
    return rows.select(
        "s", "c", "d", (F.col("_by_code") + F.col("_by_digest")).alias("earlier"),
        F.when(alone, F.when(F.col("_by_code") == 1, F.col("c1")).otherwise(F.col("d1"))).alias("rival"))


def chain_steps(pending: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``settled`` by chains: rows without rival are accepted, and along each chain that begins at such
    a row every other one."""
    known = durable(rivals(pending), "rivals")
    ends = known.filter("earlier <> 1").select(F.col("s").alias("up"), (F.col("earlier") == 0).alias("accepted"))
    chain = known.filter("earlier = 1").select("s", F.col("rival").alias("up"), F.lit(1).alias("odd"))
    chain = durable(chain.join(ends.select("up", F.lit(True).alias("ended")), "up", "left").select(
        "s", "up", "odd", F.coalesce("ended", F.lit(False)).alias("ended")), "chain")
    while not (going := chain.filter("not ended")).isEmpty():
        # what a row looks at is a row of a chain too: it looks on to where that one looks
        over = chain.select(F.col("s").alias("up"), F.col("up").alias("next"), F.col("odd").alias("more"), "ended")
        moved = going.drop("ended").join(over, "up").select("s", F.col("next").alias("up"), ((F.col("odd") + F.col("more")) % 2).alias("odd"), "ended")
        chain = durable(chain.filter("ended").unionByName(moved), "chain")
    told = chain.join(ends.filter("accepted"), "up", "left_semi").select("s", (F.col("odd") == 0).alias("won"))
    heads = known.filter("earlier = 0").select("s", "c", "d")
    winners = heads.unionByName(known.join(told.filter("won"), "s", "left_semi").select("s", "c", "d"))
    return settled(pending, winners, told.filter("not won"))


# --- components ------------------------------------------------------------------------------

def components(pending: DataFrame) -> DataFrame:
    """s, c, d, component of every pending row. Rows are tied to the earliest of their key; labels take
    the smallest of their ties and then the label of their label, until nothing changes."""
    def ties(key: str) -> DataFrame:
        lowest = pending.groupBy(key).agg(F.min("s").alias("b"))
        return pending.select(F.col("s").alias("a"), key).join(lowest, key).filter("a <> b").select("a", "b")

    one_way = ties("d").unionByName(ties("c"))  # equal NULL codes don't meet in a join
    edges = durable(one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "ties")
    labels = pending.select("s", F.col("s").alias("label"))
    while True:
        near = edges.join(labels.select(F.col("s").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near.select(F.col("a").alias("s"), "near"), "s", "left").select(
            "s", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # the old label's row hears of the new one too, so whole trees move at once
        told = hooked.filter("label < old").groupBy(F.col("old").alias("s")).agg(F.min("label").alias("told"))
        hooked = durable(hooked.join(told, "s", "left").select("s", "old", F.least("label", "told").alias("label")), "labels")
        above = hooked.select(F.col("s").alias("label"), F.col("label").alias("above"))
        jumped = durable(hooked.join(above, "label").select("s", "old", F.least("label", "above").alias("label")), "labels")
        labels = jumped.select("s", "label")
        if jumped.filter("label <> old").isEmpty():
            return pending.join(labels.withColumnRenamed("label", "component"), "s")


def decide_in_order(rows: pa.Table) -> pa.Table:
    """``won`` for rows with a place (order within the component), c and d."""
    rows = rows.sort_by("place")
    codes, digests, won = set(), set(), []
    for code, digest in zip(rows.column("c").to_pylist(), rows.column("d").to_pylist()):
        free = digest not in digests and (code is None or code not in codes)
        if free:
            digests.add(digest)
            codes.add(code)
        won.append(free)
    return rows.append_column("won", pa.array(won)).select(["component", "place", "won"])


def small_components(labelled: DataFrame, task_rows: int) -> tuple[DataFrame, DataFrame, int]:
    """Stored (winners among components of at most ``task_rows`` rows, rows of the others, their
    number). ``labelled``: stored s, c, d, component."""
    sizes = labelled.groupBy("component").agg(F.count("*").alias("size"))
    sized = labelled.join(sizes, "component")
    small = sized.filter(F.col("size") <= task_rows).withColumn(
        "place", F.row_number().over(Window.partitionBy("component").orderBy("s")))
    small = durable(small.select("s", "c", "d", "component", "place"), "small")
    types = {f.name: f.dataType.simpleString() for f in small.schema.fields}
    decided = small.select("component", "place", "c", "d").groupBy("component").applyInArrow(
        decide_in_order, f"component {types['component']}, place int, won boolean")
    winners = small.join(decided.filter("won"), ["component", "place"], "left_semi").select("s", "c", "d")
    large = sized.filter(F.col("size") > task_rows).select("s", "c", "d")
    state = durable(winners.withColumn("won", F.lit(True)).unionByName(large.withColumn("won", F.lit(False))), "round")
    return state.filter("won").drop("won"), state.filter("not won").drop("won"), state.filter("not won").count()


def accept_few(keys: DataFrame) -> DataFrame:
    """``s`` of the rows that first-wins accepts, decided one by one in a single task and without stored
    steps: for at most ``TASK_ROWS`` rows, as the caller knows."""
    placed = keys.select("s", "c", "d", F.lit(0).alias("component")).withColumn(
        "place", F.row_number().over(Window.partitionBy("component").orderBy("s")))
    order = keys.schema["s"].dataType.simpleString()
    return placed.groupBy("component").applyInArrow(decide_few, f"s {order}")


def decide_few(rows: pa.Table) -> pa.Table:
    won = decide_in_order(rows).column("won")
    return rows.sort_by("place").filter(won).select(["s"])


# --- all together -------------------------------------------------------------------------------

def accept(pending: DataFrame, task_rows: int = TASK_ROWS, plain_rounds: int = 2) -> DataFrame:
    """``s`` of the rows of ``pending`` (stored: s, c, d) that first-wins accepts."""
    accepted: list[DataFrame] = []
    left, rounds = 1, 0
    while left:
        if rounds < plain_rounds:
            won, pending, left = settled(pending, firsts(pending))
        elif left <= task_rows:
            # few rows are one component, whether they touch or not
            won, pending, left = small_components(pending.withColumn("component", F.lit(0)), task_rows)
        else:
            won, pending, left = chain_steps(pending)
            if left > task_rows:
                accepted.append(won.select("s"))
                won, pending, left = small_components(durable(components(pending), "components"), task_rows)
        accepted.append(won.select("s"))
        rounds += 1
    out = accepted[0]
    for part in accepted[1:]:
        out = out.unionByName(part)
    return out
