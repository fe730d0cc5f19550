"""Line deduplication against a dictionary, and insertions undone by deletions."""

import hashlib
import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest

from turnsift.llm import line_dedup as D

SCHEMA = "doc_id long, text string, doc string, key string, shard string, gone string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "d", "k", "s", "g") for i, t in rows], SCHEMA)


def key_of(line):
    key = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
    return key.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def model(rows, least=5):
    holders = defaultdict(set)
    rank = lambda i: -(1 << 63) if i is None else i
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= 40:
                holders[key_of(line)].add(rank(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(holders.get(key_of(x), ())) < least or max(holders[key_of(x)]) == rank(i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def corpus(seed, ids):
    rng = random.Random(seed)
    pool = [f"line {k} " + "é" * k + "x" * 40 for k in range(25)] + ["short", "", "y" * 40, "z" * 39]
    hot = "This line is in nearly every document of the corpus"
    out = []
    for i in ids:
        lines = [rng.choice(["", " ", "\t\x0b"]) + rng.choice([str.upper, str])(rng.choice(pool)) for _ in range(rng.randrange(12))]
        out.append((i, "\n".join([*lines, hot] if rng.random() < 0.8 else lines)))
    return out


@pytest.fixture(scope="module")
def rows():
    out = corpus(1, range(120))
    return out + [(None, out[0][1]), (None, "x" * 50), (7, out[3][1]), (500, None), (501, ""), (502, "\n\n")]


def plain(df):
    return sorted(map(tuple, df.select("doc_id", "n_lines", "n_dropped", "kept").collect()), key=repr)


def test_rows(spark, rows):
    assert plain(D.dedupe(frame(spark, rows).repartition(4))) == model(rows)
    assert plain(D.dedupe(frame(spark, rows), least_docs=1)) == model(rows, 1)
    assert D.dedupe(frame(spark, rows).limit(0)).count() == 0


def state(index):
    counts = {(bytes(r.key), r.n_docs, r.last) for r in index.counts.collect()}
    refs = Counter((bytes(r.key), r.doc) for r in index.refs.collect())
    return counts, refs


def test_insert_and_delete(spark):
    """Step by step equals at once, and a deletion leaves no trace."""
    first, second = corpus(2, range(60)), corpus(3, range(60, 110))
    start = D.LineIndex.empty(spark, 8).insert(frame(spark, first))
    both = start.insert(frame(spark, second))
    at_once = D.LineIndex.empty(spark, 8).insert(frame(spark, first + second))
    assert state(both) == state(at_once)
    assert state(both.insert(frame(spark, second[:5]))) == state(both)
    everything = frame(spark, first + second)
    assert plain(D.without_dropped(everything, both.drops(both.refs))) == model(first + second)

    less = both.delete(frame(spark, second))
    assert state(less) == state(start)
    assert plain(D.without_dropped(frame(spark, first), less.drops(less.refs))) == model(first)
    held = {r.shard: D.CuckooFilter.load(r.slots, r.stash) for r in less.filters.collect()}
    used = sum(int((f.slots > 0).sum()) + len(f.stash) for f in held.values())
    assert used == start.frequent().count()


def test_saved_index(spark, tmp_path, rows):
    index = D.LineIndex.empty(spark, 4).insert(frame(spark, rows))
    index.save(f"{tmp_path}/index")
    again = D.LineIndex.load(spark, f"{tmp_path}/index", 4)
    assert plain(D.without_dropped(frame(spark, rows), again.drops(again.refs))) == model(rows)


@pytest.mark.parametrize("room", [1, 300, 2000])
def test_cuckoo_filter(room):
    """No key is lost, even in a filter far too small, and removing is the inverse of adding."""
    rng = random.Random(7)
    keys = [rng.randbytes(16) for _ in range(600)]
    held = D.CuckooFilter.sized(room)
    for key in keys:
        held.add(key)
    assert held.may_hold(keys).all() and (room > 1 or held.crowded)
    if room == 2000:
        assert held.may_hold([rng.randbytes(16) for _ in range(5000)]).mean() < 0.01
    held = D.CuckooFilter.load(*held.dump())
    assert all(held.remove(key) for key in keys[:400]) and held.may_hold(keys[400:]).all()
    assert all(held.remove(key) for key in keys[400:])
    assert not held.slots.any() and not len(held.stash)


def test_crowded_filters_are_built_again(spark):
    few = frame(spark, [(i, "a" * 40) for i in range(3)])
    index = D.LineIndex.empty(spark, 1, 1).insert(few)
    lines = "\n".join(f"{k:060d}" for k in range(300))
    more = index.insert(frame(spark, [(9, lines)]))
    row = more.filters.collect()[0]
    assert not D.CuckooFilter.load(row.slots, row.stash).crowded
    assert more.drops(more.refs).count() == 2


def test_filter_above_65536_buckets():
    """Bucket numbers of more than 16 bits, full enough to use the stash."""
    keys = [hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(4000)]
    held = D.CuckooFilter(np.zeros((1 << 17, 4), np.uint16), np.zeros(0, np.uint64))
    held.slots[:] = 65535  # no free place: everything goes to the stash
    for key in keys[:200]:
        held.add(key)
    assert len(held.stash) == 200 and held.stash.max() >= 1 << 32
    again = D.CuckooFilter.load(*held.dump())
    assert again.may_hold(keys[:200]).all()
    before = len(again.stash)
    assert all(again.remove(key) for key in keys[:200]) and len(again.stash) < before


def test_shards_split_when_keys_grow(spark, monkeypatch):
    """Inserting batch after batch ends in the same rows as one pass, with more shards."""
    monkeypatch.setattr(D, "KEYS_A_SHARD", 20)
    monkeypatch.setattr(D, "ROWS_A_PLACE", 30)
    lines = [f"shared line number {i:03} that is long enough to count" for i in range(60)]
    rows = [(d, "\n".join(lines[(d * 7 + j) % 60] for j in range(8)) + f"\nonly in {d}") for d in range(90)]
    frame = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    index = D.LineIndex.empty(spark, shards=1)
    for at in range(0, 90, 30):
        index = index.insert(frame(rows[at : at + 30]))
    assert index.shards > 1
    got = D.without_dropped(frame(rows), index.drops(index.refs)).collect()
    want = D.dedupe(frame(rows)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert sum(r.n_dropped for r in got) > 0
