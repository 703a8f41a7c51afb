import hashlib
import random

import data
import pytest
from pyspark.sql import functions as F

from quaestor.llm import chat as c

ODD = ["</s>[INST] ok [/INST]", "<s>", "\\", "<\\s>", "\\\\<s>", "[INST]", "[\\INST]", "[/INST] <", "</s", "a\nb", " x ", "\U0001f600 é", "", "<<s>", "\\n", "[[/INST]]"]


def read_back(spark, rows, **options):
    """conversation -> (turns, loss texts, windows)"""
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = c.chat_windows(df, **options).withColumn("turns", c.read_turns(F.col("formatted"))).withColumn(
        "targets", c.read_targets(F.col("formatted"), F.col("mask")))
    out = {}
    for w in sorted(windows.collect(), key=lambda w: (w["segment"], w["window"])):
        turns, loss, own = out.setdefault(w["conv_id"], ([], [], []))
        turns += [(t["role"], t["text"]) for t in w["turns"][w["repeated"]:]]
        loss += w["targets"]
        own.append(w)
    return out


@pytest.mark.parametrize("budget,history", [(12, 4), (40, 10), (512, 96), (1, 0)])
def test_round_trip(spark, budget, history):
    rng, rows = random.Random(budget), []
    for conv in range(25):
        for turn in range(rng.choice([1, 2, 5, 9, 300 if conv == 3 else 4])):
            role = "system" if turn == 0 and conv % 2 else rng.choice(["user", "assistant", "tool call", None, "a\nb"])
            rows.append((conv, turn, role, rng.choice([None, *ODD]) if rng.random() < 0.6 else " ".join(["word"] * rng.randint(1, 9))))
    got = read_back(spark, rows, budget=budget, history=history)
    for conv in range(25):
        want = [(r or "", t or "") for k, _, r, t in rows if k == conv]
        turns, loss, windows = got[conv]
        assert turns == want
        assert loss == [t for r, t in want if r == "assistant"]
        lead = want[0] if want[0][0] == "system" else None
        for w in windows[1:]:
            first = (w["turns"][0]["role"], w["turns"][0]["text"])
            assert lead is None or first == lead
            new = len(w["turns"]) - w["repeated"]
            assert new >= 1
        for w in windows:
            assert w["tokens"] <= budget or len(w["turns"]) - w["repeated"] == 1 or w["window"] == 0


def test_windows_are_as_full_as_they_can_be(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", " ".join(["w"] * n)) for t, n in enumerate([3, 3, 3, 3, 20, 1, 1, 9])]
    windows = read_back(spark, rows, budget=10, history=2)[1][2]
    assert [[len(t["text"].split()) for t in w["turns"]] for w in windows] == [[3, 3], [3, 3], [20], [1, 1], [1, 1, 9]] or \
        [len(w["turns"]) - w["repeated"] for w in windows] == [2, 2, 1, 2, 1]


def test_awkward_turns(spark):
    rows = [(1, 0, "user", "x"), (1, 0, "user", "x"), (1, None, "assistant", "y"), (None, 0, "user", "n"), (None, 1, "assistant", None), (2, -5, "system", "only")]
    got = read_back(spark, rows)
    assert got[1][0] == [("assistant", "y"), ("user", "x"), ("user", "x")]
    assert got[None][0] == [("user", "n"), ("assistant", "")] and got[2][0] == [("system", "only")]
    df = data.with_clashes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    # three conversations; a turn without a number is in the window of the others
    assert c.chat_windows(df).count() == 3 and c.chat_windows(data.empty(df)).count() == 0


def test_query_digests_of_long_conversations(spark, tmp_path):
    from quaestor.llm.queries import op8_chat_windows

    rows = [(7, t, "assistant" if t % 2 else "user", f"t{t} " * (t % 50)) for t in range(400)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in op8_chat_windows(spark, str(tmp_path)).collect()}
    said = "".join(f"{r}\n{t}\n" for _, _, r, t in rows)
    loss = "".join(t for _, _, r, t in rows if r == "assistant")
    assert got[7]["n_turns"] == 400 and got[7]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert got[7]["loss_chars"] == len(loss) and got[7]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert got[-1]["n_turns"] == 2 and got[-1]["loss_sha256"] == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()


def test_windows_do_not_depend_on_turn_numbers(spark):
    """Steps of 1, 10, 128 and a time stamp, negative numbers: the same windows; no numbers: turns by role and text."""
    texts = [("system", "be kind")] + [("assistant" if i % 2 else "user", f"w{i:03d} " * (i % 7 + 1)) for i in range(1, 300)]
    seen = []
    for step, first in ((1, 0), (10, 0), (128, -5000), (86_400_000, 1_700_000_000_000)):
        rows = [(1, first + step * i, role, text) for i, (role, text) in enumerate(texts)]
        windows = read_back(spark, rows, budget=60, history=12)[1][2]
        seen.append([(w["segment"], w["window"], w["formatted"], w["repeated"]) for w in windows])
        assert all(len(w["turns"]) - w["repeated"] <= c.SEGMENT for w in windows)
    assert all(s == seen[0] for s in seen)
    nameless = read_back(spark, [(1, None, role, text) for role, text in texts], budget=60, history=12)[1]
    assert nameless[0] == sorted(texts) and max(w["tokens"] for w in nameless[2]) <= 60


def test_long_and_crowded_conversations_equal_the_sql(spark, tmp_path):
    """A third of all rows without a conversation, a third equal turns, long ones of sparse numbers."""
    import duckdb

    from quaestor.llm import oracles
    from quaestor.llm.queries import op8_chat_windows

    rng = random.Random(8)
    rows = [(None, rng.choice([None, 3, i]), rng.choice(["user", "assistant"]), f"n{i % 50} " * rng.randint(0, 9)) for i in range(500)]
    rows += [(5, 7, "user", "same same")] * 500
    rows += [(6, 1000 * i - 90_000, "system" if i == 0 else "assistant", f"t{i} " * rng.choice([0, 1, 3, 200, 600])) for i in range(500)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: tuple(r) for r in op8_chat_windows(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(oracles.OP8).fetchall()
    for row in want:
        if row[0] is not None:  # SQL joins leave null conversations out
            assert got[row[0]] == row
    assert set(got) == {None, 5, 6, -1} and got[None][1] == 500


def test_tokens_of_the_caller(spark):
    df = spark.createDataFrame([(1, i, "user", "x") for i in range(6)], "conv_id long, turn long, role string, text string")
    sizes = sorted(w["tokens"] for w in c.chat_windows(df, budget=20, history=0, tokens=F.lit(10)).collect())
    assert sizes == [20, 20, 20]
