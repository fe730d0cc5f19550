"""Hard negatives against full inner products in plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnsift.llm import bond as B

SCHEMA = "vec_id long, embedding array<double>, label int, vector string, row string, n string, score string"
EXTRA = ("a", "b", "c", "d")


def usable(row):
    i, v, label = row
    return i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, anchors, low=80, n=5):
    rows = [(k, i, [math.floor(256 * x) for x in v], label) for k, (i, v, label) in enumerate(rows) if usable((i, v, label))]
    out = []
    for k, i, v, label in rows:
        if not anchors(i):
            continue
        scored = sorted(
            ((max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), j, other, m) for m, j, w, other in rows if m != k),
            key=lambda r: (-r[0], r[1], r[3]),
        )
        for p, j, _, _ in [r for r in scored if r[2] == label][:n]:
            fits = [r for r in scored if r[2] != label and low * p <= 100 * r[0] <= 100 * p][:n]
            out += [(i, j, rank, r[1], p, r[0]) for rank, r in enumerate(fits, 1)]
    return sorted(out)


def found(spark, rows, anchor="vec_id % 10 = 0", parts=3):
    table = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(parts)
    got = B.hard_negatives(table, F.expr(anchor), F.col("label"))
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(n, dims=16, labels=4, seed=1, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(i, (rng.standard_normal(dims) * scale / math.sqrt(dims)).tolist(), int(rng.integers(labels))) for i in range(n)]


def tens(i):
    return i % 10 == 0


def test_against_all_products(spark):
    rows = vectors(700) + [(10_000 + i, [0.25] * 16, i % 2) for i in range(60)]
    assert found(spark, rows) == brute(rows, tens)


def test_many_blocks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_VALUES", 16 * 20)
    monkeypatch.setattr(B, "GROUP_ROWS", 7)
    rows = vectors(400, seed=2)
    assert found(spark, rows, parts=2) == brute(rows, tens)


def test_one_label_for_most_rows(spark):
    rows = [(i, v, 0 if i % 3 else label) for i, v, label in vectors(500, seed=3)]
    assert found(spark, rows) == brute(rows, tens)


def test_rows_that_take_no_part(spark):
    good = vectors(150, dims=6, labels=2, seed=4)
    bad = [(200, None, 1), (210, [1.0, None], 1), (220, [float("nan")], 0), (230, [float("inf")], 0), (None, [1.0], 1), (240, [0.5], None)]
    odd = [(250, [], 0), (260, [0.5, 0.25], 1), (260, [0.5, 0.25], 0), (270, [0.1] * 9, 0), (270, [0.1] * 9, 0), (0, [0.3] * 6, 1)]
    rows = good + bad + odd
    assert found(spark, rows) == brute(rows, tens)


def test_scores_beyond_doubles_and_longs(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([1e5, 3e5, -1e5, 123456.789]) for _ in range(8)], i % 2) for i in range(60)]
    assert found(spark, rows) == brute(rows, tens)
    rows = [(i, [rng.choice([1e9, 1.5e9, -1e6, 2e7]) for _ in range(8)], i % 2) for i in range(60)]
    assert found(spark, rows) == brute(rows, tens)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0], 0), (1, [0.9], 0), (2, [0.85], 1)]
    assert found(spark, rows) == brute(rows, tens) == [(0, 1, 1, 2, 58880, 55552)]
    assert found(spark, rows[:1]) == [] == found(spark, [])
    assert found(spark, rows, anchor="vec_id < 0") == []


@pytest.mark.parametrize("n", [3, 5])
def test_bounds_only_drop_rows_that_cannot_count(n):
    """Some columns are saved, and what is left is the exact answer."""
    rng = np.random.default_rng(n)
    block = np.floor(rng.standard_normal((64, 3000)) * 32)
    block[:, :40] = np.floor(block[:, :1] + rng.standard_normal((64, 40)) * 4)
    scan, read = B._Scan(block), []
    steps = scan.steps(block[:, 0], np.arange(1, 3000))

    def judge(lower, upper):
        read.append(len(lower))
        return upper >= B._nth_best(lower, n)

    alive, score = B._finish(steps, judge)
    want = block[:, 0] @ block[:, 1:]
    best = np.argsort(-want, kind="stable")[:n] + 1
    assert set(best) <= set(alive.tolist())
    assert (score == want[alive - 1]).all()
    assert read[-1] < 100 and sum(read) < 0.9 * 8 * 2999
