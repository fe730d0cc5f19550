"""Shards: places, balance, versions and growth; sizes and places recounted in plain Python."""

import random
import zlib
from collections import Counter, defaultdict

import pandas as pd

from turnsift.llm import sharding as S

SCHEMA = "doc_id long, text string, size string, shard string, rank string, virtual_slot string"
EXTRA = ("a", "b", "c", "d")


def frame(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


def recount(got, rows, shards):
    """Every row once, measured as in Python, with a place of its own in its shard."""
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        assert 0 <= r.shard < shards
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    loads = defaultdict(int)
    for r in got:
        loads[r.shard] += r.size
    return [loads[s] for s in range(shards)]


def corpus(n, seed=1):
    rng = random.Random(seed)
    return [(rng.choice([None, i, i]), rng.choice([None, "", "é" * rng.randrange(60), "word " * rng.randrange(200)])) for i in range(n)]


def test_near_equal_bytes_and_reruns(spark):
    rows = corpus(3000)
    got = S.shard(frame(spark, rows), shards=7, slots=256).collect()
    loads = recount(got, rows, 7)
    assert max(loads) - min(loads) <= 0.002 * sum(loads) / 7
    again = S.shard(frame(spark, rows[::-1]).repartition(5), shards=7, slots=256).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_a_third_of_all_rows_equal(spark):
    """One record repeated a thousand times is one slot, dealt in lanes."""
    rows = [(7, "same text")] * 1000 + corpus(1500, 2)
    got = S.shard(frame(spark, rows), shards=10, slots=128).collect()
    loads = recount(got, rows, 10)
    assert max(loads) - min(loads) <= 0.02 * sum(loads) / 10
    hot = Counter(r.shard for r in got if r.doc_id == 7 and r.text_crc32 == zlib.crc32(b"same text"))
    assert len(hot) >= 3
    slots = {r.virtual_slot for r in got if r.doc_id == 7 and r.text_crc32 == zlib.crc32(b"same text")}
    assert len(slots) == 1


def test_a_null_id_in_every_row(spark):
    rows = [(None, f"text number {i}") for i in range(800)]
    loads = recount(S.shard(frame(spark, rows), shards=8, slots=256).collect(), rows, 8)
    assert max(loads) - min(loads) <= 64


def test_long_text_and_fewer_rows_than_shards(spark):
    rows = [(1, "long " * 1_000_000), (2, "x"), (3, None)]
    got = S.shard(frame(spark, rows), shards=5).collect()
    recount(got, rows, 5)
    assert len({r.shard for r in got}) == 3


def test_empty(spark):
    assert S.shard(frame(spark, []).limit(0), shards=4).count() == 0


def some_map(n=900, shards=6, seed=4):
    rng = random.Random(seed)
    sums = pd.DataFrame({
        "virtual_slot": range(n), "lanes": 1, "lane": 0, "rows": [rng.randrange(1, 9) for _ in range(n)],
        "bytes": [int(rng.paretovariate(1.3) * 100) for _ in range(n)],
    }).astype({"virtual_slot": "int32", "lanes": "int32", "lane": "int32"})
    return S.first_map(sums, shards)


def test_rebalance_edits_few_entries():
    held = some_map()
    loads = held.groupby("shard")["bytes"].sum()
    new = S.rebalanced(held, 6)
    after = new.groupby("shard")["bytes"].sum()
    assert after.max() - after.min() < 0.001 * after.mean() < loads.max() - loads.min()
    assert (new["shard"] != held["shard"]).mean() < 0.3
    assert (S.rebalanced(new, 6)["shard"] != new["shard"]).sum() == 0


def test_growth_moves_rows_only_into_the_new_shard():
    held = S.rebalanced(some_map(), 6)
    new = S.grown(held, 6)
    moved = new[new["shard"] != held["shard"]]
    assert set(moved["shard"]) == {6}
    share = new.groupby("shard")["bytes"].sum()
    assert share.max() - share.min() < 0.05 * share.mean()


def test_versions(spark, tmp_path):
    """Only edits are appended; every version can be read back."""
    path = str(tmp_path / "map")
    first = some_map()
    second = S.rebalanced(first, 6)
    third = S.grown(second, 6)
    assert S.store_edits(spark, path, first) == 1
    assert S.store_edits(spark, path, second, first) == 2
    assert S.store_edits(spark, path, third, second) == 3
    assert S.store_edits(spark, path, third, third) == 3
    stored = spark.read.parquet(path).toPandas()
    assert (stored["version"] == 1).sum() == len(first)
    assert (stored["version"] == 2).sum() == (first["shard"] != second["shard"]).sum()
    for version, want in ((1, first), (2, second), (3, third), (None, third)):
        read = S.load_map(spark, path, version).toPandas().sort_values("virtual_slot", ignore_index=True)
        assert (read["shard"] == want["shard"]).all() and (read["bytes"] == want["bytes"]).all()
