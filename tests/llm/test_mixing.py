"""Mixing against a small sequential model of targets and streams."""

import random
from collections import defaultdict

import pytest

from turnsift.llm import mixing as M

SCHEMA = "doc_id long, source string, text string, size string, sid string, _row string"


def targets(sizes):
    """Round after round: share by weight, cut at the limit, share the excess again."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_ = 1.5 * sum(sizes.values()), set(names)
    out = dict.fromkeys(names, 0.0)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            out[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if out[s] >= 2 * sizes[s]:
                left += out[s] - 2 * sizes[s]
                out[s] = 2.0 * sizes[s]
                open_.discard(s)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def words(n):
    return " \t".join("w%d" % i for i in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(700):
        source = rng.choice(["a"] * 6 + ["b", "c", "é", "z", None])
        rows.append((i, source, words(rng.choice([0, 1, 5, 40, 400, 5000] if i % 50 == 0 else [1, 5, 40]))))
    return rows + [(None, "b", "x y"), (None, "b", "x y"), (5, "a", None), (7, "q", ""), (8, "q", " \n "), (9, "tiny", "one")]


def test_targets_and_taken(spark, corpus):
    sizes = defaultdict(int)
    for _, source, text in corpus:
        sizes[source] += len((text or "").split())
    want = targets(sizes)
    docs = frame(spark, corpus)
    got = M.mix(docs, block_words=64, keep=("source",)).collect()
    assert len(got) == len(corpus)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(r.taken_by_pass)
        taken[r.source] += r.taken
    for source, goal in want.items():
        assert taken[source] == round(goal) or abs(taken[source] - goal) <= 0.5
    again = M.mix(frame(spark, corpus[::-1]).repartition(7), block_words=64, keep=("source",)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_streams_are_read_in_order(spark):
    """Within a source the taken words are a prefix of its repeated stream: at most one document
    is taken in part in a pass."""
    rows = [(i, "ab"[i % 5 == 0], words(10 + i % 7)) for i in range(200)]
    got = M.mix(frame(spark, rows), block_words=8, keep=("source",)).collect()
    for source in "ab":
        for p in (0, 1):
            part = [r for r in got if r.source == source and 0 < r.taken_by_pass[p] < r.size]
            assert len(part) <= 1


def test_points_are_even():
    """The margin covers the discrepancy of the point sequence for shares of any size."""
    n = 5000
    points = [((i * M._GOLDEN) % M._UNIT) / M._UNIT for i in range(1, n + 1)]
    for low, high in [(0, 0.001), (0.3, 0.31), (0.5, 0.9), (0.999, 1)]:
        assert abs(sum(low <= x < high for x in points) - n * (high - low)) < 4


def test_empty_and_copies(spark, corpus):
    docs = frame(spark, corpus)
    assert M.mix(docs.limit(0)).count() == 0
    assert M.mix(frame(spark, [(1, None, None), (2, "a", "")])).collect()[0].taken == 0
    once = frame(spark, [(1, "a", "x y z"), (1, "a", "x y z"), (None, None, "p q")])
    rows = M.mixed_rows(once)
    assert rows.columns == docs.columns
    counts = defaultdict(int)
    for r in M.mixed_rows(docs).collect():
        counts[r.doc_id, r.source, r.text] += 1
    plain = defaultdict(int)
    for r in M.mix(docs, keep=("source", "text")).collect():
        plain[r.doc_id, r.source, r.text] += sum(r.size > 0 and 2 * t >= r.size for t in r.taken_by_pass)
    assert dict(counts) == {k: v for k, v in plain.items() if v}


def test_no_python_in_the_plan(spark, corpus):
    plan = M.mix(frame(spark, corpus))._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop") if w in plan]
