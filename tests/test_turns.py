"""The stateful turn processor: continuing stored sessions, expiry, late messages."""

import time

import pytest
from pyspark.sql import functions as F

from turnsift.operators import chain
from turnsift.streaming import jobs, turns

SCHEMA = "session_id string, turn_index int, event_id string, ts timestamp, role string, content string"
CONTENT = ["session_id", "turn_index", "role", "content"]


def rows(session, first, n, minute=0):
    return [
        (session, first + i, f"{session}:{first + i:04}", f"2024-01-01 {10 + (minute + i) // 60:02}:{(minute + i) % 60:02}:00",
         "tool" if i % 2 else "user", f"text {first + i} of {session}")
        for i in range(n)
    ]


@pytest.fixture
def frame(spark):
    def make(listed):
        df = spark.createDataFrame([(s, t, e, None, r, c) for s, t, e, _, r, c in listed], SCHEMA)
        stamps = spark.createDataFrame([(e, ts) for _, _, e, ts, _, _ in listed], "event_id string, stamp string")
        df = df.join(stamps, "event_id").withColumn("ts", F.to_timestamp("stamp")).drop("stamp")
        return df.select(*SCHEMA.replace(" string", "").replace(" int", "").replace(" timestamp", "").split(", "))

    return make


def run(spark, folder, number, heads=None, **options):
    """What a stream over the files so far puts out in this run."""
    schema = spark.read.parquet(f"{folder}/in").schema
    messages = jobs.read_log(spark, f"{folder}/in", schema).withColumn("digest", chain.content_digest(CONTENT))
    stream = turns.continued_turns(messages, heads, **options)
    with turns.state_in_rocksdb(spark):
        writer = stream.writeStream.foreachBatch(lambda df, i: df.write.parquet(f"{folder}/out{number}/{i}"))
        writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out{number}/*").collect()


def hashes(spark, frame, listed):
    built = chain.build_chain(frame(listed).withColumn("digest", chain.content_digest(CONTENT)))
    return {r.event_id: (r.turn_index, r.prev_hash, r.event_hash) for r in built.collect()}


def test_stream_continues_stored_sessions(spark, frame, tmp_path):
    stored = rows("a", 0, 5) + rows("b", 0, 1)
    later = rows("a", 5, 3, 5) + rows("b", 1, 2, 1) + rows("new", 0, 2)
    want = hashes(spark, frame, stored + later)
    held = frame(stored).withColumn("digest", chain.content_digest(CONTENT))
    heads = turns.heads_of(held, chain.build_chain(held))
    frame(later[:4]).write.parquet(f"{tmp_path}/in")
    got = run(spark, tmp_path, 1, heads)
    frame(later[4:]).write.mode("append").parquet(f"{tmp_path}/in")
    got += run(spark, tmp_path, 2, heads)
    assert {r.event_id: (r.turn_index, r.prev_hash, r.event_hash) for r in got} == {e: want[e] for _, _, e, *_ in later}
    window = next(r for r in got if r.event_id == "a:0005")
    assert window.window_size == 3 and not any(r.late for r in got)


def test_idle_state_goes_and_late_messages_are_scanned(spark, frame, tmp_path):
    """After its time to live a session starts anew; before, an old message comes out as late, with
    its text."""
    frame(rows("idle", 0, 3, 300)).write.parquet(f"{tmp_path}/in")
    first = run(spark, tmp_path, 1, keep_ms=60_000)
    assert [r.turn_index for r in sorted(first, key=lambda r: r.event_id)] == [0, 1, 2]
    old = [("idle", 90, "idle:late", "2024-01-01 09:00:00", "tool", "an old payload")]
    frame(old).write.mode("append").parquet(f"{tmp_path}/in")
    (late,) = run(spark, tmp_path, 2, keep_ms=60_000)
    assert late.late and late.turn_index is None and late.own_text == "an old payload"
    signals = jobs.late_turns(spark.createDataFrame([late], turns._OUT))
    assert signals.count() == 1


def test_state_expires(spark, frame, tmp_path):
    frame(rows("gone", 0, 2)).write.parquet(f"{tmp_path}/in")
    run(spark, tmp_path, 1, keep_ms=1)
    time.sleep(0.5)
    frame(rows("gone", 2, 1, 2)).write.mode("append").parquet(f"{tmp_path}/in")
    (again,) = run(spark, tmp_path, 2, keep_ms=1)
    assert (again.turn_index, again.prev_hash) == (0, "")
