"""Counts and keys against plain Python, and held-out labels."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from turnsift.llm import importance as I

SMALL = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, key string, selected string, quality string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", "s", "q") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    good, bad = [f"good{i}" for i in range(50)], [f"bad{i}" for i in range(50)]
    out = [(i, " ".join(rng.choice(good if i % 3 else bad) for _ in range(rng.randrange(1, 200)))) for i in range(300)]
    return out + [(500, None), (501, ""), (None, "good1 good2"), (None, "good1 good2"), (7, out[7][1])]


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 3 > 0), 0) for i in range(0, 150)] + [(300, 1, 1), (None, 1, 0), (1, None, None), (2, 1, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def gram_counts(texts, buckets):
    bucket, _ = I.grams(pa.array(texts), buckets)
    return np.bincount(bucket, minlength=buckets)


def test_models_count_everything(spark, rows, labels):
    ids = I.target_ids(labels)
    assert set(ids) == {i for i in range(150) if i % 3}
    assert len(I.target_ids(labels, 10)) == 10
    table = I.train(frame(spark, rows).repartition(4), ids, 1024)
    target = gram_counts([t for i, t in rows if i in set(ids.tolist())], 1024).astype(float)
    raw = gram_counts([t for _, t in rows], 1024).astype(float)
    assert table == pytest.approx(I.log_ratios(target, raw))


def test_grams_of_words():
    bucket, row = I.grams(pa.array(["A b a b", None, "x", ""]), 1 << 16)
    assert Counter(row.tolist()) == {0: 7, 2: 1}
    own = bucket[row == 0].tolist()
    assert own[0] == own[2] and own[1] == own[3] and own[4] == own[6] != own[5]


def test_weights_against_plain_python(spark, rows, labels):
    """The weight is the whole sum over words and word pairs, for short and for long texts."""
    docs = frame(spark, [*rows, (900, "good1 bad2 " * 4000)])
    table = I.train(docs, I.target_ids(labels))

    def one(text):
        words = (text or "").lower().split()
        grams = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        return len(grams), sum(float(table[I.grams(pa.array([g]), len(table))[0][-1]]) for g in grams)

    for temperature in (1.0, 4.0):
        got = {r.doc_id: r for r in I.weigh(docs, table, temperature).collect()}
        for i, text in [(500, None), (501, ""), *rows[:20]]:
            n, total = one(text)
            assert got[i].n_grams == n and got[i].importance == pytest.approx(total / temperature)
            assert got[i].log_ratio == pytest.approx(total / max(n, 1))
        word = [float(table[I.grams(pa.array([g]), len(table))[0][-1]]) for g in ("good1", "bad2", "good1 bad2", "bad2 good1")]
        want = 4000 * (word[0] + word[1] + word[2]) + 3999 * word[3]
        assert got[900].n_grams == 15_999 and got[900].importance == pytest.approx(want / temperature)


def test_selection(spark, rows, labels):
    docs = frame(spark, rows)
    table = I.train(docs, I.target_ids(labels))
    got = I.select(I.weigh(docs.repartition(5), table), 0.6).collect()
    assert len(got) == len(rows)
    keys = sorted((r.key for r in got), reverse=True)
    limit = keys[math.ceil(0.6 * len(rows)) - 1]
    assert all(r.selected == (r.key >= limit) for r in got)
    assert {r.importance for r in got if r.doc_id in (500, 501)} == {0.0}
    by_id = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id < 300}
    assert np.mean([by_id[i].selected for i in range(150, 300) if i % 3]) > 0.65
    assert np.mean([by_id[i].selected for i in range(150, 300) if not i % 3]) < 0.35
    again = I.select(I.weigh(docs, table), 0.6).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


@pytest.mark.parametrize("values", [[5], [3, 3, 3], list(range(-5000, 5000, 7)), [-(10**15), 0, 10**15, 2, 2]])
def test_kth_largest(spark, values):
    keys = spark.createDataFrame([(v,) for v in values], "key long")
    for k in {1, 2, len(values) // 2, len(values)} - {0}:
        if k <= len(values):
            assert I.kth_largest(keys, k) == sorted(values, reverse=True)[k - 1]


def test_empty(spark, rows, labels):
    docs = frame(spark, rows)
    assert I.resample(docs.limit(0), labels).count() == 0
    none = I.resample(docs, labels.limit(0)).collect()
    assert {r.log_ratio for r in none} == {0.0} and sum(r.selected for r in none) >= 0.85 * len(none)


def test_labels_not_trained_on(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    trained = labels.filter("doc_id % 2 = 0")
    got = I.resample(docs, trained).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    good = [r.selected for r in got if r.quality == 1]
    bad = [r.selected for r in got if r.quality == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.15
