import random

import pytest
from pyspark.sql import functions as F

from turnsift.operators import behavior

TURNS = "session_id string, turn_index int, names array<string>"


def frame(spark, *turns):
    return spark.createDataFrame([("s", i, names) for i, names in enumerate(turns)], TURNS)


def diff(spark, pivot, *turns):
    calls = behavior.tool_calls(frame(spark, *turns))
    pivots = spark.createDataFrame([("s", pivot)], "session_id string, pivot_turn int")
    found = behavior.behavior_diffs(pivots, calls).first()
    names = [
        r["name"]
        for r in behavior.new_actions(pivots, calls).orderBy("first_turn", "first_call").collect()
    ]
    return found, names


def test_baseline(spark):
    turns = frame(spark, ["search", "search", "fetch"], ["search"], [])
    shares = {r["name"]: r["share"] for r in behavior.tool_distribution(turns).collect()}
    assert shares == {"search": 0.75, "fetch": 0.25}
    per_turn = behavior.tools_per_turn(frame(spark, ["a", "b"], ["c"], [])).first()
    assert per_turn["avg_tools_per_turn"] == 1.0
    ten = frame(spark, *([["first"]] * 5 + [["second"]] * 5))
    assert {r["name"] for r in behavior.tool_distribution(ten).collect()} == {"first"}


def test_pairs(spark):
    def pairs(*turns):
        found = behavior.sequential_pairs(frame(spark, *turns), chunk_rows=2)
        return [(r["first"], r["second"]) for r in found.orderBy("turn_index", "pair_no").collect()]

    assert pairs(["fetch"], ["parse"]) == [("fetch", "parse")]
    assert pairs(["a", "b", "c"], ["d"]) == [("a", "b"), ("b", "c"), ("c", "d")]
    assert pairs(["a"], [], ["b"]) == []
    assert pairs(["a"], ["b"], ["c"], ["d", "e"], ["f"]) == [
        ("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"),
    ]
    gap = spark.createDataFrame([("s", 3, ["a"]), ("s", 900, ["b"])], TURNS)
    assert behavior.sequential_pairs(gap).count() == 1
    top = behavior.common_pairs(frame(spark, ["a", "b", "a", "b", "c", "d", "e", "f", "g"])).collect()
    assert [(r["first"], r["second"], r["n"]) for r in sorted(top, key=lambda r: r["rank"])] == [
        ("a", "b", 2), ("b", "a", 1), ("b", "c", 1), ("c", "d", 1), ("d", "e", 1),
    ]


@pytest.mark.parametrize(
    "pivot, turns, before, after, new, anomaly",
    [
        (1, [["search", "fetch"], ["search"]], 2, 1, [], 0.0),
        (1, [["read_file"], ["send_email"]], 1, 1, ["send_email"], 1.0),
        (1, [["read_file"] * 5, ["send_email", "upload_doc", "execute"]], 5, 3,
         ["send_email", "upload_doc", "execute"], 0.9),
        (99, [["a"], ["b"]], 2, 0, [], 0.0),
        (0, [["a", "b"], ["a"]], 0, 3, ["a", "b"], 1.0),
        (1, [["a"] * 4, ["x", "y", "x"]], 4, 3, ["x", "y"], 0.5),
    ],
)
def test_diff(spark, pivot, turns, before, after, new, anomaly):
    found, names = diff(spark, pivot, *turns)
    assert (found["before_calls"], found["after_calls"], found["anomaly_score"]) == (before, after, anomaly)
    assert names == new and found["n_new"] == len(new)


def test_sensitive_names(spark):
    names = ["Send_Mail", "POSTER", "rewrite", "fetch", "prune", "search"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.filter(behavior.is_sensitive(F.col("n"))).collect()]
    assert got == ["Send_Mail", "POSTER", "rewrite", "prune"]


def test_many_pivots_in_long_sessions(spark):
    rng = random.Random(2)
    tools = ["read", "find", "send_a", "list", "run_b", "x", "y"]
    turns = [
        (s, t, [rng.choice(tools[: 2 + t // 20]) for _ in range(rng.randint(0, 3))])
        for s in ("a", "b")
        for t in range(100)
    ]
    pivots = [(s, t) for s in ("a", "b") for t in range(0, 100, 3)]
    calls = behavior.tool_calls(spark.createDataFrame(turns, TURNS))
    marks = spark.createDataFrame(pivots, "session_id string, pivot_turn int")
    got = {
        (r["session_id"], r["pivot_turn"]): (r["before_calls"], r["n_new"], r["anomaly_score"])
        for r in behavior.behavior_diffs(marks, calls, chunk_rows=8).collect()
    }
    for s, p in pivots:
        before = [n for q, t, names in turns if q == s and t < p for n in names]
        after = [n for q, t, names in turns if q == s and t >= p for n in names]
        new = set(after) - set(before)
        score = len(new) / max(1, len(before))
        if any(k in n for n in new for k in behavior.SENSITIVE_PARTS):
            score *= 1.5
        assert got[(s, p)] == (len(before), len(new), round(min(1.0, score), 4)), (s, p)
