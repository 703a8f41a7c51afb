"""Chat formatting into budgeted windows of whole turns, with a loss mask.

A conversation's turns, in order of turn (ties: role, text), are cut into windows. A window
begins with the conversation's system turn, if its first turn is one, then repeats the latest
whole turns before it that fit ``history`` tokens, then holds new turns: as many as fit the
rest of ``budget`` by the prefix sums of turn tokens, one at least. A turn longer than that
has a window of its own, whole. Targets are the texts of assistant turns; the loss mask covers a
target in the window where it is new and nowhere else, so each counts once.

Turns are numbered by their place in the conversation, whatever numbers they carry: sorted by ranges
over all conversations, numbered within each range and shifted by the conversation's rows in earlier
ones, so a conversation or turn number that a third of all rows share is spread over many tasks.
They are collected in segments of ``SEGMENT`` places, never by conversation. A window holds turns of
one segment, so at most that many; it repeats history from the segment before too.

The template frames each turn as ``<s>[INST] role [/INST] text</s>``. Backslashes in texts are
doubled and a control string gets one after its bracket, roles are URL-encoded; ``read_turns``
gives back exactly what went in.

Null texts and roles are empty strings; null turn numbers come first; rows without a conversation
id are one conversation of id null. Repeated rows are turns like any other. Columns beside
conv_id, turn, role and text are not read. An empty table gives no windows. Everything is
DataFrame operations on built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.session import durable, once

SEGMENT = 128
TOKEN = r"[\p{L}\p{N}_]+|[^\x20\x09-\x0D\p{L}\p{N}_]"
OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST] ", "</s>"
CONTROL = r"(/?(?:s>|INST\]))"


def count_tokens(text: Column) -> Column:
    """Words and single other characters."""
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"([<\[])" + CONTROL, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"([<\[])\\" + CONTROL, "$1$2"), F.lit("\\\\"), F.lit("\\"))


def framed(role: Column, text: Column) -> Column:
    """``text`` is escaped already."""
    return F.concat(F.lit(OPEN), F.url_encode(role), F.lit(MIDDLE), text, F.lit(CLOSE))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted window holds."""
    frames = F.filter(F.split(formatted, CLOSE), lambda f: f != "")
    return F.transform(frames, lambda f: F.struct(
        F.url_decode(F.regexp_extract(f, r"(?s)^<s>\[INST\] (.*?) \[/INST\] ", 1)).alias("role"),
        unescaped(F.regexp_replace(f, r"(?s)^<s>\[INST\] .*? \[/INST\] ", "")).alias("text")))


def read_targets(formatted: Column, mask: Column) -> Column:
    """The texts under the loss mask."""
    return F.transform(mask, lambda span: unescaped(F.substring(formatted, span["start"] + 1, span["length"])))


def window_starts(turns: Column, room: Column) -> Column:
    """Indices at which windows begin: a turn begins one when the prefix sum at its end is more
    than ``room`` beyond that at the start of the current one."""
    begin = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).cast("long").alias("base"))

    def step(state: Column, i: Column) -> Column:
        turn = F.get(turns, i)
        new = (i == 0) | (turn["before"] + turn["tokens"] - state["base"] > room)
        return F.when(new, F.struct(F.concat(state["starts"], F.array(i)).alias("starts"), turn["before"].alias("base"))).otherwise(state)

    return F.aggregate(F.sequence(F.lit(0), F.size(turns) - 1), begin, step)["starts"]


def in_places(rows: DataFrame) -> DataFrame:
    """``rows`` (key, turn, role, text, ...) stored with ``place``: 0, 1, ... within each key in the order of
    turn, role, text. Rows equal in all of these are told apart by where they were read, so that
    they spread too."""
    order = ["key", "turn", "role", "text", "_read"]
    dealt = rows.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    # of a row in the sorted parts: number of the part in the high bits, place in the part in the low 33
    dealt = durable(dealt.drop("_read").withColumn("_at", F.monotonically_increasing_id()), "turns")
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33))
    parts = dealt.groupBy("key", "_part").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    before = F.sum("_rows").over(Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # stored, so that Spark knows its size: as long as it is small, texts need not move to meet it
    parts = durable(parts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_rows"), "parts")
    placed = dealt.join(parts, ["key", "_part"])
    return placed.withColumn("place", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_before", "_first")


def chat_windows(turns: DataFrame, budget: int = 512, history: int = 96, target: str = "assistant", tokens: Column | None = None) -> DataFrame:
    """One row per window: conv_id, segment, window (order within the conversation), formatted,
    mask (array of start, length in code points), repeated (how many of its first turns are
    repeats), tokens. ``tokens``: whole numbers per turn in place of ``count_tokens``."""
    rows = turns.select(
        "conv_id", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")).alias("key"),
        F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        (tokens if tokens is not None else count_tokens(F.coalesce("text", F.lit("")))).cast("long").alias("tokens"))
    rows = in_places(rows).withColumn("segment", F.floor(F.col("place") / SEGMENT))
    segments = rows.groupBy("conv_id", "key", "segment").agg(
        F.sort_array(F.collect_list(F.struct("place", "role", "text", "tokens"))).alias("turns"))
    # only a full segment has one after it, so short conversations take no part in the joins
    full = F.size("turns") == SEGMENT
    opening = F.get("turns", F.lit(0))
    opening = F.when(opening["role"] == "system", F.struct(opening["role"].alias("role"), opening["text"].alias("text"), opening["tokens"].alias("tokens")))
    first = segments.filter("segment = 0").withColumn("system", opening)
    system = first.filter(full & F.col("system").isNotNull()).select("key", "system")
    segments = first.unionByName(segments.filter("segment > 0").join(system, "key", "left")).withColumn("full", full)
    own = F.when((F.col("segment") == 0) & F.col("system").isNotNull(), F.slice("turns", 2, F.greatest(F.size("turns") - 1, F.lit(0)))).otherwise(F.col("turns"))
    sums = F.aggregate(own, F.struct(F.array().cast("array<struct<role:string,text:string,tokens:bigint,before:bigint>>").alias("out"), F.lit(0).cast("long").alias("sum")), lambda s, t: F.struct(
        F.concat(s["out"], F.array(F.struct(t["role"].alias("role"), t["text"].alias("text"), t["tokens"].alias("tokens"), s["sum"].alias("before")))).alias("out"),
        (s["sum"] + t["tokens"]).alias("sum")))
    segments = once(segments, _sums=sums)
    segments = segments.select("conv_id", "key", "segment", "system", "full", F.col("_sums.out").alias("turns"), F.col("_sums.sum").alias("total"))

    # what later windows may repeat of a segment, ``before`` counted back from its end
    tails = segments.filter("full").select("key", (F.col("segment") + 1).alias("segment"), F.transform(
        F.filter("turns", lambda t: F.col("total") - t["before"] <= history),
        lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["tokens"].alias("tokens"), (t["before"] - F.col("total")).alias("before"))).alias("tail"))
    later = segments.filter("segment > 0").join(tails.filter(F.size("tail") > 0), ["key", "segment"], "left")
    segments = segments.filter("segment = 0").unionByName(later, allowMissingColumns=True)

    room = F.greatest(F.lit(budget) - F.coalesce(F.col("system.tokens"), F.lit(0)) - history, F.lit(1))
    # a conversation of a system turn alone has no other turn; its window holds that one
    starts = F.when(F.size("turns") > 0, window_starts(F.col("turns"), room)).otherwise(F.array(F.lit(0)))
    cut = once(segments, starts=starts).select("*", F.posexplode("starts").alias("window", "start"))
    cut = cut.filter((F.size("turns") > 0) | (F.col("segment") == 0))
    stop = F.coalesce(F.get("starts", F.col("window") + 1), F.size("turns"))
    new = F.slice("turns", F.col("start") + 1, stop - F.col("start"))
    since = F.coalesce(F.get("turns", F.col("start"))["before"], F.lit(0))
    earlier = F.concat(F.coalesce(F.col("tail"), F.slice("turns", 1, 0)), F.slice("turns", F.lit(1), F.col("start")))
    before = F.filter(earlier, lambda t: since - t["before"] <= history)
    leading = F.when(F.col("system").isNotNull(), F.array("system")).otherwise(F.array().cast("array<struct<role:string,text:string,tokens:bigint>>"))

    def piece(t: Column, is_new: bool) -> Column:
        return F.struct(t["role"].alias("role"), escaped(t["text"]).alias("text"), t["tokens"].alias("tokens"),
                        (F.lit(is_new) & (t["role"] == target)).alias("target"))

    parts = once(cut, _lead=leading, _hist=before, _new=new)
    parts = once(parts, pieces=F.concat(
        F.transform("_lead", lambda t: piece(t, False)), F.transform("_hist", lambda t: piece(t, False)), F.transform("_new", lambda t: piece(t, True))))
    frames = F.transform("pieces", lambda p: framed(p["role"], p["text"]))
    opening = len(OPEN) + len(MIDDLE)
    mask = F.aggregate("pieces", F.struct(F.array().cast("array<struct<start:int,length:int>>").alias("spans"), F.lit(0).alias("at")), lambda s, p: F.struct(
        F.when(p["target"], F.concat(s["spans"], F.array(F.struct(
            (s["at"] + opening + F.length(F.url_encode(p["role"]))).alias("start"), F.length(p["text"]).alias("length"))))).otherwise(s["spans"]).alias("spans"),
        (s["at"] + F.length(framed(p["role"], p["text"]))).alias("at")))["spans"]
    fresh_system = F.when((F.col("segment") == 0) & (F.col("window") == 0), 0).otherwise(F.size("_lead"))
    return parts.select(
        "conv_id", "segment", "window", F.array_join(frames, "").alias("formatted"), mask.alias("mask"),
        (fresh_system + F.size("_hist")).alias("repeated"),
        F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["tokens"]).alias("tokens"))
