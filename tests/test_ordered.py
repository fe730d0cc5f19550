import random

import pytest
from pyspark.sql import functions as F

from turnsift.operators import ordered, pairing
from turnsift.operators.components import connected_components


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for session in ("hot", "a", "b"):
        turns = rng.sample(range(1000), 300 if session == "hot" else 7)
        out += [(session, t, rng.randint(0, 99)) for t in turns]
    rng.shuffle(out)
    return out


def brute(rows):
    for session in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == session)
        total, best = 0, None
        for n, (_, turn, value) in enumerate(own):
            total += value
            best = value if best is None else max(best, value)
            yield (session, turn), (n, own[n - 1][2] if n else None, total, best)


@pytest.mark.parametrize("width", [1, 7, 64, 10_000])
def test_chunks_do_not_change_results(spark, rows, width):
    df = spark.createDataFrame(rows, "session_id string, turn int, value int").repartition(5)
    chunk = ordered.chunk_of(F.col("turn"), width)
    got = ordered.with_position(df, ["session_id"], ["turn"], chunk)
    got = ordered.with_previous(got, ["session_id"], ["turn"], chunk, ["value"])
    got = ordered.with_running(
        got, ["session_id"], ["turn"], chunk,
        {"total": (F.sum, F.col("value")), "best": (F.max, F.col("value"))},
    )
    found = {
        (r["session_id"], r["turn"]): (
            r["pos"], r["previous"]["value"] if r["previous"] else None, r["total"], r["best"]
        )
        for r in got.collect()
    }
    assert found == dict(brute(rows))


@pytest.mark.parametrize("width", [1, 2, 7, 64, 10_000])
@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_last_rows(spark, rows, width, size):
    """Chunks with fewer rows than the window, gaps between chunks, and a null key."""
    rows = [r for r in rows if r[0] != "hot" or r[1] < 60] + [(None, t, t) for t in (0, 1, 40, 41, 900)]
    df = spark.createDataFrame(rows, "session_id string, turn int, value int").repartition(3)
    got = ordered.with_last_rows(df, ["session_id"], ["turn"], ordered.chunk_of(F.col("turn"), width), ["turn", "value"], size)
    assert got.columns == [*df.columns, "last_rows"]
    found = {(r["session_id"], r["turn"]): [tuple(x) for x in r["last_rows"]] for r in got.collect()}
    want = {}
    for session in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == session)
        for n, row in enumerate(own):
            want[session, row[0]] = own[max(0, n - size + 1) : n + 1]
    assert found == want


def test_turn_numbers_continue(spark):
    log = spark.createDataFrame(
        [("a", 2, "2024-01-01 05:00:00"), ("a", 1, "2024-01-01 00:00:00"), ("b", 3, "2024-01-01 00:00:00"),
         ("a", 0, "2024-01-01 05:00:00")],
        "session_id string, event_id int, t string",
    ).select("session_id", "event_id", F.to_timestamp("t").alias("ts"))
    known = spark.createDataFrame([("a", 4)], "session_id string, last_turn int")
    got = {r["event_id"]: r["turn_index"] for r in pairing.number_turns(log, known).collect()}
    assert got == {1: 5, 0: 6, 2: 7, 3: 0}


def test_pairs_by_run_and_by_session(spark):
    ts = "timestamp_seconds(%d)"
    starts = spark.sql(
        "SELECT * FROM VALUES ('r1','s',timestamp_seconds(1),'q1'),('r2','s',timestamp_seconds(2),'q2'),"
        "('r3','s',timestamp_seconds(3),'q3') AS t(run_id, session_id, ts, request)"
    )
    ends = spark.sql(
        "SELECT * FROM VALUES ('r1',timestamp_seconds(5),'a1'),('r1',timestamp_seconds(9),'dup'),"
        "('r3',timestamp_seconds(6),'a3'),('r9',timestamp_seconds(6),'lost') AS t(run_id, ts, response)"
    )
    errors = spark.createDataFrame([("r3",)], "run_id string")
    got = [(r["run_id"], r["request"], r["response"]) for r in pairing.pair_by_run(starts, ends, errors).collect()]
    assert got == [("r1", "q1", "a1")]
    log = spark.createDataFrame(
        [("s", 1, "start", "u1"), ("s", 2, "start", "u2"), ("s", 3, "end", "x"), ("s", 4, "end", "y"),
         ("s", 5, "start", "u3"), ("s", 6, "error", "e"), ("s", 7, "end", "z")],
        "session_id string, seq int, kind string, text string",
    ).withColumn("ts", F.timestamp_seconds("seq"))
    got = sorted((r["request"], r["response"], r["matched"]) for r in pairing.pair_in_session(log).collect())
    assert got == [("", "y", False), ("", "z", False), ("u2", "x", True)]
    assert pairing.pair_in_session(log, keep_unmatched=False).count() == 1


def test_components_against_union_find(spark):
    rng = random.Random(5)
    ids = [f"n{i:03d}" for i in range(120)]
    edges = [(rng.choice(ids), rng.choice(ids)) for _ in range(90)]
    edges += [(ids[i], ids[i + 1]) for i in range(0, 60)] + [("n070", i) for i in ids[80:110]]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = sorted((find(a), find(b)))
        parent[rb] = ra
    got = connected_components(
        spark.createDataFrame([(i,) for i in ids], "id string"),
        spark.createDataFrame(edges, "src string, dst string"),
    ).collect()
    assert {r["id"]: r["component"] for r in got} == {i: find(i) for i in ids}
    empty = connected_components(
        spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([], "src string, dst string")
    )
    assert empty.first()["component"] == "a"


def test_rank_of_a_burst_in_one_second(spark, monkeypatch):
    """A key whose rows all lie in one second is split over several tasks, and null keys are a key."""
    kept, stored = [], ordered.written
    monkeypatch.setattr(ordered, "written", lambda df, name: kept.append(stored(df, name)) or kept[-1])
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        burst = spark.range(4000).select(
            F.when(F.col("id") % 4 > 0, "hot").when(F.col("id") % 8 == 0, F.concat(F.lit("k"), (F.col("id") % 5).cast("string"))).alias("k"),
            F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"), (F.col("id") * 7919 % 4001).alias("event"),
        )
        got = ordered.with_rank(burst, ["k"], ["ts", "event"], "pos")
        rows = got.select("k", "event", "pos").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(rows) == 4000
    by_key = {}
    for r in rows:
        by_key.setdefault(r.k, []).append((r.event, r.pos))
    assert set(by_key) == {"hot", None, "k0", "k1", "k2", "k3", "k4"}
    for found in by_key.values():
        assert [p for _, p in sorted(found)] == list(range(len(found)))
    assert kept[0].filter("k = 'hot'").select(F.shiftright("_at", 33)).distinct().count() >= 3
    assert ordered.with_rank(burst.limit(0), ["k"], ["event"]).count() == 0
