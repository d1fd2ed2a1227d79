import random

import hashlib
import time

from pyspark.sql import functions as F

from storelens.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, block string, window string, tok string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA).repartition(3)


def expect(rows):
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        target = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[c] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(target), hashlib.sha256(target.encode()).hexdigest())
    return out


ODD = [
    (1, 0, "system", "be <kind> \\l \\b"), (1, 1, "user", None), (1, 2, "assistant", "</turn>\n<turn user>\nno"), (1, 3, "user", "\\"), (1, 4, "assistant", ""),
    (2, None, "user", "first"), (2, 5, None, "no role"), (2, 5, "assistant", "tie a"), (2, 5, "assistant", "tie a"), (2, 5, "a>b\n", "odd role"),
    (None, 0, "user", "no conversation"), (3, 0, "assistant", "é\U0001f600 " * 3000), (4, -3, "assistant", "negative turn"),
]


def test_round_trip_and_targets_once(spark):
    rows = ODD + [(9, k, "assistant" if k % 2 else "user", f"turn {k} " + "w " * (k % 30)) for k in range(700)] + [(9, 700, "system", "late")]
    for budget in (64, 1024):
        got = chat.digests(chat.windows(frame(spark, rows), budget, 2, 24)).collect()
        assert {r.conv_id: tuple(r)[1:5] for r in got} == expect(rows)


def test_windows_keep_the_system_turn_the_budget_and_history(spark):
    rows = [(5, 0, "system", "s s s")] + [(5, k, "assistant" if k % 2 == 0 else "user", "a b c d e f") for k in range(1, 300)]
    got = sorted(chat.windows(frame(spark, rows), 100, 2, 30).collect(), key=lambda r: (r.block, r.window))
    assert len(got) > 10 and all(r.text.startswith("<turn system>\ns s s\n</turn>\n") and r.tokens <= 100 for r in got)
    assert sum(r.n_turns for r in got) == 300 and sum(len(r.loss) for r in got) == 149
    assert [r.n_context for r in got][1:] == [3] * (len(got) - 1)  # the system turn and two of history, over block edges too
    assert all(r.text[s.start : s.end] == "a b c d e f" for r in got for s in r.loss)


def test_crowded_turns_and_rows_without_an_id(spark):
    """100000 rows of one conversation and one turn number, without an id: blocks hold rows, not numbers."""
    began = time.time()
    rows = spark.range(100_000).select(F.lit(None).cast("long").alias("conv_id"), F.lit(7).alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text "), F.col("id") % 50).alias("text"))
    out = chat.windows(rows).agg(F.sum("n_turns").alias("n"), F.sum(F.size("loss")).alias("loss"), F.max("tokens").alias("most"), F.count_distinct("block").alias("blocks")).first()
    assert (out.n, out.loss, out.blocks) == (100_000, 50_000, -(-100_000 // chat.BLOCK)) and out.most <= 1024 and time.time() - began < 120


def test_empty(spark):
    assert chat.digests(chat.windows(frame(spark, []))).count() == 0


def windows_of(spark, turns, **options):
    df = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)], "conv_id long, turn int, role string, text string").repartition(3)
    return sorted(chat.windows(df, **options).collect(), key=lambda r: (r.block, r.window))


def test_no_system_turn_comes_before_its_time(spark):
    turns = [("user", "a b"), ("assistant", "c d"), ("system", "LATE RULE"), ("user", "e f"), ("assistant", "g h"), ("system", "NEXT RULE"), ("user", "i j"), ("assistant", "k l")]
    rows = windows_of(spark, turns, budget=20, history_turns=1, history_tokens=6)
    at = 0
    for r in rows:
        first = at
        at += r.n_turns
        held = [t for _, (role, t) in enumerate(turns[: first + 1]) if role == "system"]
        if turns[first][0] != "system":  # which stands in its place itself
            assert r.text.startswith("<turn system>\n" + held[-1]) if held else not r.text.startswith("<turn system>")
        assert r.tokens <= 20 and r.text.count("LATE RULE") <= 1 and r.text.count("NEXT RULE") <= 1
    assert at == len(turns) and len(rows) > 3


def test_windows_keep_their_budget(spark):
    rng = random.Random(5)
    for seed in range(3):
        turns = [(rng.choice(["user", "assistant", "system"] if k % 9 == 0 else ["user", "assistant"]), " ".join(["w"] * rng.choice([0, 1, 5, 30, 120 if k % 11 == 0 else 2]))) for k in range(300)]
        rows = windows_of(spark, turns, budget=64, history_turns=3, history_tokens=20)
        assert sum(r.n_turns for r in rows) == len(turns)
        at = 0
        for r in rows:
            size = [4 + len(t.split()) for _, t in turns[at : at + r.n_turns]]
            at += r.n_turns
            assert r.tokens <= 64 or (r.n_turns == 1 and r.n_context == 0 and size[0] > 64)


def test_a_system_turn_over_the_budget_is_left_out(spark):
    turns = [("system", "x " * 2000)] + [("user", "hello there"), ("assistant", "fine")] * 2
    rows = windows_of(spark, turns, budget=1024)
    assert [r.tokens > 1024 for r in rows] == [True, False] and rows[1].n_turns == 4
