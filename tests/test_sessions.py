import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from turnsift import schema as S
from turnsift.operators import chain, sessions
from turnsift.sources import tables

SIGNALS = (
    "session_id string, turn_index int, msg_index int, stage string, score double, source string"
)
EVENTS = "event_id string, session_id string, turn_index int, timestamp timestamp, model string, agent_name string"


def at(minute):
    return dt.datetime(2024, 1, 1, 0, minute)


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(
        [("e1", "a", 0, at(0), "m1", "x"), ("e2", "a", 1, at(1), "m2", "y"), ("e3", "b", 0, at(5), "m1", None),
         ("e4", "c", 0, at(9), "m1", None)],
        EVENTS,
    )


@pytest.fixture(scope="module")
def signals(spark):
    return spark.createDataFrame(
        [("a", 1, None, "drift", 0.5, None), ("a", 1, 2, "message", 0.5, "second"),
         ("a", 1, 1, "message", 0.5, "first"), ("a", 0, 0, "message", 0.3, "early"),
         ("b", 0, 0, "message", 0.8, "src")],
        SIGNALS,
    )


def test_listing_and_status(spark, events, signals):
    got = {r["session_id"]: r for r in sessions.list_sessions(events, signals).collect()}
    a = got["a"]
    assert (a["model"], a["agent_name"], a["turn_count"], a["started_at"]) == ("m1", "x", 2, at(0))
    assert (a["max_signal_score"], a["top_source"], a["verdict"]) == (0.5, "first", "suspicious")
    assert (got["b"]["verdict"], got["c"]["verdict"], got["c"]["max_signal_score"]) == ("compromised", "clean", None)
    status = {r["session_id"]: tuple(r)[1:] for r in sessions.session_status(events, signals).collect()}
    assert status == {
        "a": ("suspicious", 0.5, 2, 4), "b": ("compromised", 0.8, 1, 1), "c": ("clean", 0.0, 1, 0),
    }
    best = {(r["session_id"], r["turn_index"]): r["source"] for r in sessions.best_per_turn(signals).collect()}
    assert best == {("a", 1): "first", ("a", 0): "early", ("b", 0): "src"}
    running = {(r["session_id"], r["turn_index"]): r["max_so_far"] for r in sessions.running_max(signals).collect()}
    assert running == {("a", 0): 0.3, ("a", 1): 0.5, ("b", 0): 0.8}


def test_append_rejects_known_and_repeated_ids(spark, events):
    rows = [("e1", "a", 5, at(30), "m", None), ("n1", "d", 0, at(31), "m", None),
            ("n1", "d", 0, at(32), "m", None), ("n2", "d", 1, at(33), "m", None)]
    batch = spark.createDataFrame(rows + [rows[3]] * 3, EVENTS)
    accepted, rejected = sessions.split_new_events(events, batch)
    assert sorted((r["event_id"], r["timestamp"]) for r in accepted.collect()) == [("n1", at(31)), ("n2", at(33))]
    assert accepted.columns == batch.columns
    marked = sessions.with_rejections(events, batch).filter("rejected").collect()
    assert sorted((r["event_id"], r["copies"]) for r in marked) == [("e1", 1), ("n1", 1), ("n2", 3)]
    assert rejected.count() == 3


def test_purge_and_timeline(spark, events, signals):
    left = sessions.purge_sessions(events, spark.createDataFrame([("a",)], "session_id string"))
    assert sorted(r["session_id"] for r in left.collect()) == ["b", "c"]
    turns = spark.createDataFrame(
        [("b", 0, "m", [("user", "x" * 250), ("tool", "short")], ["t1"]), ("c", 0, "m", [], [])],
        "session_id string, turn_index int, model string, "
        "messages array<struct<role:string,content:string>>, tools array<string>",
    )
    rows = {r["session_id"]: r for r in sessions.timeline(turns, signals).collect()}
    assert rows["b"]["previews"] == ["[user] " + "x" * 200 + "…", "[tool] short"]
    assert (rows["b"]["highlight"], rows["c"]["highlight"], rows["c"]["score"]) == ("red", "none", None)


def test_tables_round_trip(spark, tmp_path):
    message = ("user", "hé", None, None)
    call = ("id", "search", '{"q": 1}', "ok")
    row = ("e", "s", 0, at(0), [message], message, [call], "m", ["https://x"], "", "h")
    events = spark.createDataFrame([row], S.TRACE_EVENTS)
    path = str(tmp_path / "events")
    tables.write_events(events, path)
    tables.write_events(events.withColumn("session_id", F.lit("t")), path)
    back = tables.read_table(spark, path, S.TRACE_EVENTS)
    assert back.columns[-1] == "event_date"
    back = back.drop("event_date")
    assert tuple(tables.session_events(back, ["s"]).first()) == tuple(events.first())
    plan = tables.session_events(back, ["s"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(session_id)" in plan or "In(session_id" in plan or "EqualTo(session_id" in plan
    out = str(tmp_path / "json")
    tables.export_json(events, out)
    text = spark.read.text(out).first()["value"]
    assert json.loads(text)["messages_in"][0] == {"role": "user", "content": "hé", "tool_call_id": None, "tool_calls": None}
    good, bad = tables.decode_payloads(spark.createDataFrame([(text,), ('{"event_id": ',)], "payload string"))
    assert good.first()["tool_calls"][0]["name"] == "search" and bad.count() == 1


def test_signals_round_trip(spark, tmp_path, signals):
    path = str(tmp_path / "signals")
    wide = signals.withColumn("matched_heuristics", F.array(F.lit("H01"))).withColumn("evidence_snippet", F.lit("e"))
    tables.write_signals(wide, path)
    back = tables.session_signals(tables.read_table(spark, path, S.SIGNALS), ["a"])
    assert [r["turn_index"] for r in back.collect()] == [0, 1, 1, 1]


def test_session_ids_and_corpora(spark):
    df = spark.createDataFrame([("a/b c.d-e_é",), ("",), (None,)], "session_id string")
    good, bad = tables.with_safe_session_id(df)
    assert [r[0] for r in good.collect()] == ["a_b_c_d-e__"] and bad.count() == 2
    corpus = spark.createDataFrame([(1, " x\t"), (2, " \n "), (3, None), (4, "y")], "k int, t string")
    assert [r["t"] for r in tables.load_payloads(corpus, "k", "t").orderBy("k").collect()] == ["x", "y"]
    assert tables.load_payloads(corpus, "k", "t", 2).count() == 1


def chained(spark, rows, heads=None):
    df = spark.createDataFrame(rows, "session_id string, turn_index int, event_id string, body string")
    df = df.withColumn("digest", chain.content_digest(["session_id", "turn_index", "body"]))
    built = chain.build_chain(df, heads)
    return built.join(df.select("event_id", "body", "digest"), "event_id")


def check(df):
    verified = chain.with_hash_check(chain.with_link_check(df, chunk_rows=2), F.col("digest"))
    return {r["session_id"]: r["chain_valid"] for r in chain.chain_validity(verified).collect()}


def test_chain(spark):
    rows = [(s, t, f"{s}{t}", f"body {t}") for s in ("a", "b", "c") for t in range(7)]
    built = chained(spark, rows)
    stored = spark.createDataFrame(built.collect(), built.schema)
    assert check(stored) == {"a": True, "b": True, "c": True}
    changed = F.when(F.col("event_id") == "b3", F.sha2(F.lit("x"), 256)).otherwise(F.col("digest"))
    assert check(stored.withColumn("digest", changed)) == {"a": True, "b": False, "c": True}
    assert check(stored.filter("event_id <> 'c4'"))["c"] is False
    forged = F.when(F.col("event_id") == "a0", "0" * 64).otherwise(F.col("event_hash"))
    assert check(stored.withColumn("event_hash", forged))["a"] is False
    heads = stored.groupBy("session_id").agg(F.max_by("event_hash", "turn_index").alias("last_hash"))
    more = chained(spark, [("a", 7, "a7", "late"), ("new", 0, "n0", "first")], heads)
    both = stored.unionByName(more.select(*stored.columns))
    assert check(both) == {"a": True, "b": True, "c": True, "new": True}


def test_imported_trace_hash(spark):
    import hashlib

    event = {
        "event_id": "e", "session_id": "s", "turn_index": 0, "timestamp": "2024-01-01T00:00:00Z",
        "messages_in": [{"role": "user", "content": "hé \"q\"\n", "tool_call_id": None, "tool_calls": None}],
        "message_out": {"role": "assistant", "content": "", "tool_call_id": None, "tool_calls": None},
        "tool_calls": [{"id": "1", "name": "n", "arguments": {"b": 1.5, "a": [True, None]}, "result": None}],
        "model": "m", "external_sources": [], "prev_hash": "", "event_hash": "ignored",
    }
    body = {k: v for k, v in event.items() if k != "event_hash"}
    want = hashlib.sha256(json.dumps(body, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    df = spark.createDataFrame(
        [(json.dumps(event), "", want), (json.dumps({**event, "model": "other"}), "", want)],
        "payload string, prev_hash string, event_hash string",
    )
    assert [r["hash_ok"] for r in chain.with_imported_hash_check(df).collect()] == [True, False]
