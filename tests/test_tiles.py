"""Tile comparison against one matrix product, for any group sizes."""

import tracemalloc

import numpy as np
import pytest

from turnsift.functions.grams import gram_matrix
from turnsift.operators import fingerprints as fp, tiles
from turnsift.operators.tiles import best_of, compare, first_of


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 8))
    out = np.vstack([b + 0.3 * rng.normal(size=(12, 8)) for b in base])
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def frames(spark, vectors):
    rows = [(f"r{i:03d}", v.tolist()) for i, v in enumerate(vectors)]
    refs = [(f"f{i:03d}", f"{(i * 37) % 100:03d}", v.tolist()) for i, v in enumerate(vectors[::3])]
    return (
        spark.createDataFrame(rows, "id string, vector array<double>"),
        spark.createDataFrame(refs, "ref string, rank string, vector array<double>"),
        refs,
    )


@pytest.mark.parametrize("sizes", [(1000, 1000), (50, 7), (13, 1000)])
def test_choices(spark, vectors, sizes):
    rows, refs, listed = frames(spark, vectors)
    groups = {"row_group": sizes[0], "ref_group": sizes[1]}
    scores = np.round(vectors @ np.array([v for _, _, v in listed]).T, 12)
    order = sorted(range(len(listed)), key=lambda k: listed[k][1])
    best = {r["id"]: (r["ref"], r["cos"]) for r in best_of(compare(rows, refs, 0.6, "best", **groups)).collect()}
    first = {r["id"]: r["rank"] for r in first_of(compare(rows, refs, 0.6, "first", **groups)).collect()}
    climbed = {}
    for r in compare(rows, refs, 0.6, "climb", **groups).collect():
        climbed.setdefault(r["id"], []).append((r["rank"], r["cos"]))
    for i in range(len(vectors)):
        near = [k for k in order if scores[i, k] >= 0.6]
        name = f"r{i:03d}"
        if not near:
            assert name not in best and name not in first and name not in climbed
            continue
        top = max(near, key=lambda k: (scores[i, k], -order.index(k)))
        assert best[name][0] == listed[top][0] and best[name][1] == pytest.approx(scores[i, top])
        assert first[name] == listed[near[0]][1]
        peaks, high = [], -1.0
        for rank, cos in sorted(climbed[name]):
            if cos > high:
                peaks.append(rank)
                high = cos
        want, high = [], -1.0
        for k in near:
            if scores[i, k] > high:
                want.append(listed[k][1])
                high = scores[i, k]
        assert peaks == want


def test_leaders_equal_a_sequential_pass(spark, vectors):
    rows, _, _ = frames(spark, vectors)
    want = []
    for i, v in enumerate(vectors):
        if not want or max(round(float(vectors[k] @ v), 12) for k in want) < 0.7:
            want.append(i)
    got = fp._leaders(rows, 0.7, {"row_group": 40, "ref_group": 25})
    assert sorted(r["id"] for r in got.collect()) == [f"r{i:03d}" for i in want]
    assert fp._leaders(rows.limit(0), 0.7, {}).count() == 0


def test_working_arrays_are_small():
    assert tiles._AT_ONCE * tiles.REF_GROUP * 8 <= 1 << 24
    texts = ["some words of a text " * 50] * 1500
    tracemalloc.start()
    gram_matrix(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
