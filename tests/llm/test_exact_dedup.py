"""Grace deduplication against a dictionary of whole texts."""

import hashlib
import random
import string
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from turnsift.llm import exact_dedup as E

SCHEMA = "doc_id long, text string, _row string, _hash string, first string, bucket string"


def lower(text):
    return (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "r", "h", "f", "b") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    texts = [None, "", " ", "A", "a", "É", "é", "x" * 70_000, "X" * 70_000 + "y", "hot", "HOT"]
    texts += ["".join(rng.choice("abAB \n") for _ in range(rng.randrange(4))) for _ in range(300)]
    out = [(i, t) for i, t in enumerate(texts)]
    out += [(1000 + i, "Hot" if i % 2 else "hOT") for i in range(400)]
    out += [(None, "lost"), (None, "lost"), (None, "a"), (5, "twice"), (5, "twice")]
    rng.shuffle(out)
    return out


def model(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        for i in ids:
            out[(i, keep, len(ids), digest)] += 1
    return out, groups


@pytest.mark.parametrize("bucket,task", [(E.BUCKET_BYTES, E.TASK_BYTES), (600, 200), (1, 1)])
def test_groups(spark, rows, bucket, task):
    want, groups = model(rows)
    got = E.copy_groups(frame(spark, rows).repartition(5), bucket, task).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("bucket,task", [(E.BUCKET_BYTES, E.TASK_BYTES), (600, 200)])
def test_kept_rows(spark, rows, bucket, task):
    _, groups = model(rows)
    docs = frame(spark, rows).repartition(5)
    got = E.keep_one(docs, bucket, task)
    assert got.columns == docs.columns
    found = {lower(r.text): r for r in got.collect()}
    assert got.count() == len(groups) == len(found)
    for text, r in found.items():
        assert r.doc_id == max((i for i in groups[text] if i is not None), default=None)
        assert (r.doc_id, r.text) in rows and r._hash == "h" and r.bucket == "b"


def test_levels_go_on_until_buckets_fit(spark):
    sizes = spark.createDataFrame([(i, 100) for i in range(400)], "hash long, n_bytes long")
    plan = E._levels(sizes, 500, "hash")
    assert len(plan) > 1 and plan[-1][1] is None


def test_equal_hashes_do_not_make_equal_texts():
    table = E.ContentTable(2)
    assert table.put(7, b"a") == (0, True)
    assert table.put(7, b"b") == (1, True)
    assert table.put(7, b"a") == (0, False)
    assert [table.put(i, b"%d" % i)[1] for i in range(100)] == [True] * 100
    assert table.put(55, b"55")[1] is False


def test_empty(spark, rows):
    docs = frame(spark, rows).limit(0)
    assert E.copy_groups(docs).count() == 0 and E.keep_one(docs).count() == 0


def test_losers_are_let_go(monkeypatch):
    """Ascending copies replace each other; the rows they came in do not pile up."""
    monkeypatch.setattr(E, "TASK_BYTES", 1_000)
    batches = [
        pa.RecordBatch.from_pydict({"doc_id": [10 * i, 10 * i + 1], "text": ["Same" * 50, f"own {i % 3}"]})
        for i in range(60)
    ]
    out = list(E._winners(((False, b) for b in batches), None, "text", None, "doc_id", (), "h"))
    rows = {r["text"]: r["doc_id"] for b in out for r in b.to_pylist()}
    assert rows == {"Same" * 50: 590, "own 0": 571, "own 1": 581, "own 2": 591}


def test_batches_of_copies_are_let_go():
    before, most = pa.total_allocated_bytes(), []

    def batches():
        for n in range(20):
            most.append(pa.total_allocated_bytes() - before)
            yield False, pa.RecordBatch.from_pydict({"doc_id": [100 - n], "text": ["x" * 1_000_000]})

    kept = list(E._winners(batches(), None, "text", None, "doc_id", (), None))
    assert [row["doc_id"] for b in kept for row in b.to_pylist()] == [100]
    assert max(most) < 5_000_000
