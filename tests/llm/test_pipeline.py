"""Every stage against brute force on what its predecessor kept."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline as P
from turnsift.llm import byte_bpe, language_id, mixing
from turnsift.operators.durable import written

import test_exact_dedup
import test_mixing
import test_ngram_join

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The tables before the first stage and after each."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        out.append(written(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns(stages):
    assert all(t.columns == stages[0].columns for t in stages[:-1])
    assert [name for name, _ in P.STAGES] == ["language", "exact_copies", "near_copies", "source_mix", "tokens"]


def test_language(stages):
    model = language_id.train_on_fold(stages[0])
    before = rows(stages[0])
    languages, scores = language_id.Scorer(model).predict([t for _, t in before])
    want = [r for r, lang, s in zip(before, languages, scores) if lang != "und" and s >= language_id.LEAST_SCORE]
    assert sorted(rows(stages[1])) == sorted(want) and len(want) > 0.95 * len(before)


def test_exact_copies(stages):
    groups = defaultdict(list)
    for doc_id, text in rows(stages[1]):
        groups[test_exact_dedup.lower(text)].append((doc_id, text))
    assert sorted(rows(stages[2])) == sorted(max(g) for g in groups.values())


def test_near_copies(stages):
    before = rows(stages[2])
    want = [r for r, (doc_id, _, low) in zip(before, test_ngram_join.model(before)) if doc_id == low]
    assert sorted(rows(stages[3])) == sorted(want)


def test_source_mix(stages):
    before = stages[3].collect()
    sizes = defaultdict(int)
    for r in before:
        sizes[r.source] += len(r.text.split())
    targets = test_mixing.targets(sizes)
    taken = Counter(r.doc_id for r in stages[4].collect())
    assert set(taken) <= {r.doc_id for r in before} and max(taken.values()) <= 2
    decided = {r.doc_id: r for r in mixing.mix(stages[3], keep=("source",)).collect()}
    for doc_id, r in decided.items():
        assert taken[doc_id] == sum(2 * t >= r.size for t in r.taken_by_pass) * (r.size > 0)
        assert r.target == pytest.approx(targets[r.source])


def test_tokens(stages):
    encoder = byte_bpe.encoding(byte_bpe.default_ranks())
    want = Counter((r.doc_id, r.lang, r.source, tuple(encoder.encode_ordinary(r.text))) for r in stages[4].collect())
    got = stages[5].collect()
    assert Counter((r.doc_id, r.lang, r.source, tuple(r.ids)) for r in got) == want
    assert all(r.intact and r.n_tokens == len(r.ids) for r in got)


def test_run(spark, stages):
    key = lambda r: (r.doc_id, tuple(r.ids))
    assert sorted(map(key, P.run(spark, SF).collect())) == sorted(map(key, stages[-1].collect()))


def test_edges(spark):
    """Nulls everywhere, no rows, and columns that clash with working names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row string, label string, size string"
    rows = [(None, None, None, None, None, "a", "b", "c"), (1, "", "en", None, 0, "a", "b", "c"), (2, "the house", "en", "s", 9, "a", "b", "c"),
            (2, "the house", "en", "s", 9, "a", "b", "c"), (None, "of the people", "en", None, 3, "a", "b", "c")]
    docs = spark.createDataFrame(rows, schema)
    for table in (docs, docs.limit(0)):
        for name, stage in P.STAGES:
            before, table = table.columns, written(stage(spark, table, SF), f"edge-{name}")
            assert name == "tokens" or table.columns == before
        assert table.count() == 0 or {r.doc_id for r in table.collect()} <= {2, None}
