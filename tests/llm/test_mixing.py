import data
import pytest
from pyspark.sql import functions as F

from quaestor.llm import mixing as m


def waterfall(sizes, weights, most=3):
    """The definition: deal by weight, stop at the limit, deal the excess again."""
    target, open_, left = {}, set(sizes), sum(sizes.values())
    while open_:
        level = left / sum(weights[s] for s in open_)
        over = [s for s in open_ if level * weights[s] >= most * sizes[s]]
        if not over:
            return target | {s: level * weights[s] for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def highest_quotients(votes, seats):
    won = dict.fromkeys(votes, 0)
    for _ in range(seats):
        best = min(votes, key=lambda p: (-votes[p] / (2 * won[p] + 1), p))
        won[best] += 1
    return won


@pytest.mark.parametrize("seed", range(6))
def test_apportionment(spark, seed):
    import random

    rng = random.Random(seed)
    votes = {p: float(rng.choice([0, 1, 5, 5, rng.randint(1, 4000)])) for p in range(rng.randint(1, 12))}
    seats = rng.choice([0, 1, 7, 200]) if sum(votes.values()) else 0
    df = spark.createDataFrame([(0, p, v, seats) for p, v in votes.items()], "g int, p int, votes double, seats long")
    got = {r["p"]: r["quota"] for r in m.apportion(df, ["g"], ["p"], "votes", "seats").collect()}
    assert got == highest_quotients(votes, seats)


def test_targets_and_taken(spark):
    words = {"a": 30_000, "b": 900, "c": 50, "": 8_000, None: 4_000, "z": 0}
    rows, n = [], 0
    for source, total in words.items():
        size = max(1, total // 40)
        for k in range(0, total, size):
            rows.append((n, " ".join(["w"] * min(size, total - k)), "en", source))
            n += 1
    rows.append((n, None, "en", "z"))
    docs = data.documents(spark, rows)
    joined = m.mix_sources(docs, shard_words=5_000).join(docs.select("doc_id", "source"), "doc_id").collect()
    assert len(joined) == len(rows)
    order = sorted((s for s in words if s is not None)) + [None]
    want = waterfall(words, {s: 1 + i % 3 for i, s in enumerate(order)})
    for source in words:
        own = [r for r in joined if r["source"] == source]
        assert all(r["source_size"] == words[source] and abs(r["target"] - want[source]) < 1e-6 for r in own)
        assert abs(sum(r["taken"] for r in own) - want[source]) <= 64 + 0.002 * want[source]
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own)


def test_awkward_rows_and_reruns(spark):
    docs = data.with_clashes(data.awkward_documents(spark))
    first = sorted(map(tuple, m.mix_sources(docs).collect()), key=str)
    assert first == sorted(map(tuple, m.mix_sources(docs.repartition(5)).collect()), key=str)
    assert len(first) == docs.count()
    assert m.mix_sources(data.empty(docs)).count() == 0
    assert m.mix_sources(docs.filter(F.col("text").isNull())).agg(F.sum("taken")).first()[0] == 0


def test_rows_without_id_or_words_and_equal_rows_are_spread(spark, monkeypatch):
    """Half of the rows have no id, a third are equal, and one source has no words at all."""
    from quaestor.llm import mixing

    monkeypatch.setattr(mixing, "COPIES", 7)
    rows = [(None, f"w{i} " * (i % 9 + 1), "en", "a") for i in range(600)] + [(5, "one and the same", "en", "a")] * 400
    rows += [(i, f"x{i} y", "en", "b") for i in range(150)] + [(i, "", "en", "c") for i in range(100)] + [(None, None, "en", "c")] * 100
    docs = data.documents(spark, rows)
    got = mixing.mix_sources(docs, block_words=8, shard_words=200).collect()
    assert len(got) == len(rows) and sorted((r["doc_id"] or -1, r["size"]) for r in got) == sorted((i or -1, len((t or "").split())) for i, t, _, _ in rows)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    by_size = {}
    for r in got:
        by_size.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert len(by_size) == 3 and all(abs(sum(taken) - target) <= 60 for (_, target), taken in by_size.items())
    again = mixing.mix_sources(docs.repartition(3), block_words=8, shard_words=200).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    # shards hold a bounded number of rows whatever ids and texts are equal
    sized = docs.select("doc_id", "source", mixing.source_key().alias("key"), mixing.word_count().alias("size"),
                        mixing.digest(F.lit(1), F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")))).alias("place"))
    crowd = mixing.folded(sized).filter("key = '=a'").withColumn("shard", F.pmod("place", F.lit(20))).groupBy("shard").count().agg(F.max("count")).first()[0]
    assert crowd < 80
