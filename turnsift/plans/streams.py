"""Registered streaming queries: the given tables as streams, run until all is read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnsift.operators import chain
from turnsift.operators.durable import ensure_checkpoint_dir, written
from turnsift.plans import overlay, sql as Q
from turnsift.plans.detection import TURN_SIGNALS_SQL, _shown
from turnsift.plans.fingerprinting import ASSIGNED
from turnsift.plans.session_tables import PAIRS_SQL
from turnsift.streaming import jobs, turns
from turnsift.streaming.outputs import TurnSink
from turnsift.streaming.sinks import SignalSink


def _folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def _table_stream(spark, sf_dir, name) -> DataFrame:
    """The table as a stream, be it one file or a folder of files."""
    schema = overlay.table(spark, sf_dir, name).schema
    return jobs.read_log(spark, f"{sf_dir}/{name}[.]parquet", schema)


def _messages(spark, sf_dir) -> DataFrame:
    planted = overlay.plant_conversations(_table_stream(spark, sf_dir, "conversations"))
    return planted.withColumn(
        "event_id", F.concat_ws(":", "session_id", F.lpad(F.col("turn_index").cast("string"), 9, "0"))
    )


def _finish(writer, folder: str) -> None:
    query = writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def _to_table(stream: DataFrame, folder: str) -> DataFrame:
    _finish(stream.writeStream.format("parquet").option("path", f"{folder}/out"), folder)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def stream_turn_signals(spark, sf_dir):
    """Every message scanned as it arrives; equals the batch result."""
    found = jobs.scan_messages(_messages(spark, sf_dir))
    return _shown(_to_table(found, _folder(spark)))


def _turns(spark, sf_dir) -> DataFrame:
    content = ["session_id", "turn_index", "role", "content"]
    messages = _messages(spark, sf_dir).withColumn("digest", chain.content_digest(content))
    return jobs.session_turns(messages)


def stream_windows(spark, sf_dir):
    """Message and window signals from keyed state; equals the batch result."""
    return _shown(_to_table(jobs.turn_signals(_turns(spark, sf_dir)), _folder(spark)))


STREAM_WINDOWS_SQL = f"""WITH {Q.ALL_SIGNALS}
SELECT session_id, turn_index, msg_index, stage, score, rules, source, ev AS evidence_snippet FROM sig"""


def stream_chain(spark, sf_dir):
    """Turn numbers and hashes from keyed state."""
    done = _to_table(_turns(spark, sf_dir), _folder(spark))
    return done.select("session_id", "turn_index", "prev_hash", "event_hash", "late")


STREAM_CHAIN_SQL = f"""WITH RECURSIVE {Q.CONV},
num AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY turn_index) AS n,
  sha256(to_json({{content: content, role: role, session_id: session_id, turn_index: turn_index}}))
    AS digest FROM conv),
ch AS (SELECT session_id, n, '' AS prev_hash, sha256(digest) AS event_hash FROM num WHERE n = 1
  UNION ALL SELECT d.session_id, d.n, c.event_hash, sha256(c.event_hash || d.digest)
  FROM ch c JOIN num d ON c.session_id = d.session_id AND d.n = c.n + 1)
SELECT session_id, CAST(n - 1 AS INTEGER) AS turn_index, prev_hash, event_hash, false AS late FROM ch"""


def stream_continued_chain(spark, sf_dir):
    """The first two turns of every session as a stored chain, the others as a stream that starts
    with its heads: together the chain of the whole session."""
    content = ["session_id", "turn_index", "role", "content"]
    digest = chain.content_digest(content)
    stored = overlay.conversations(spark, sf_dir).filter("turn_index < 2").withColumn(
        "event_id", F.concat_ws(":", "session_id", F.lpad(F.col("turn_index").cast("string"), 9, "0"))
    ).withColumn("digest", digest)
    built = written(chain.build_chain(stored), "stored-chain")
    heads = turns.heads_of(stored, built)
    messages = _messages(spark, sf_dir).filter("turn_index >= 2").withColumn("digest", digest)
    with turns.state_in_rocksdb(spark):
        done = _to_table(turns.continued_turns(messages, heads), _folder(spark))
    columns = ["session_id", "turn_index", "prev_hash", "event_hash"]
    return built.select(*columns).unionByName(done.select(*columns))


STREAM_CONTINUED_SQL = STREAM_CHAIN_SQL.replace(", false AS late", "")


def stream_running_max(spark, sf_dir):
    """Highest score per session in update mode, last update of every session."""
    folder = _folder(spark)
    scores = jobs.running_scores(jobs.scan_messages(_messages(spark, sf_dir)))
    # the updates of a stream that never has a batch
    spark.createDataFrame([], scores.schema).write.parquet(f"{folder}/out/batch_id=-1")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch_id={batch_id}")

    _finish(scores.writeStream.outputMode("update").foreachBatch(keep), folder)
    updates = spark.read.parquet(f"{folder}/out")
    return updates.groupBy("session_id").agg(
        F.max_by("max_score", "batch_id").alias("max_score"),
        F.max_by("verdict", "batch_id").alias("verdict"),
    )


STREAM_MAX_SQL = f"""WITH {Q.MESSAGE_SIGNALS}
SELECT session_id, max(score) AS max_score, {Q.three_way('max(score)')} AS verdict
FROM msg GROUP BY session_id"""


def stream_unique_events(spark, sf_dir):
    """The event log sent twice; the second copy is dropped."""
    def log() -> DataFrame:
        return _table_stream(spark, sf_dir, "events").select(
            "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type"
        )

    once = jobs.unique_events(log().union(log()), "ts", "60 days")
    return _to_table(once, _folder(spark)).select("event_id", "user_id", "event_type")


UNIQUE_SQL = "SELECT event_id, user_id, event_type FROM events"


def stream_pairs(spark, sf_dir):
    """User turns joined with the assistant turn right after them, as two streams."""
    conv = _messages(spark, sf_dir)
    run = F.concat_ws(":", "session_id", F.col("turn_index").cast("string"))
    before = F.concat_ws(":", "session_id", (F.col("turn_index") - 1).cast("string"))
    starts = conv.filter("role = 'user'").select(
        run.alias("run_id"), "session_id", F.col("ts").alias("started_at"),
        F.length("content").alias("request"),
    )
    ends = _messages(spark, sf_dir).filter("role NOT IN ('user', 'tool')").select(
        before.alias("run_id"), F.col("ts").alias("ended_at"), F.length("content").alias("response")
    )
    done = _to_table(jobs.paired_calls(starts, ends), _folder(spark))
    return done.filter("matched").drop("matched", "error")


def _in_order(spark, messages: DataFrame, part, parts: int) -> DataFrame:
    """The messages as a stream of ``parts`` files, one a batch, in the order of ``part``."""
    folder = f"{_folder(spark)}/in"
    for number in range(parts):
        messages.filter(part == number).coalesce(1).write.mode("append").parquet(folder)
    return jobs.read_log(spark, folder, messages.schema, files_per_trigger=1)


_NO_SESSION = "nobody"


def stream_unmatched(spark, sf_dir):
    """All runs that user turns start, from four batches in the order of time: answered by the turn
    behind, failed where that is a tool's, or never ended. What never ended leaves the state of
    the join when the watermark has passed."""
    messages = written(
        overlay.conversations(spark, sf_dir).select("session_id", "turn_index", "role", "ts", F.length("content").alias("n")),
        "run-messages",
    )
    times = messages.select(F.unix_seconds("ts").alias("seconds"))
    quarter = times.approxQuantile("seconds", [0.25, 0.5, 0.75], 0.01)
    part = sum((F.unix_seconds("ts") > q).cast("int") for q in quarter)
    # a message of nobody, long after all others, lets the watermark pass them
    end = messages.agg(F.max("ts").alias("ts")).select(
        F.lit(_NO_SESSION).alias("session_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("turn_index"),
        (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"),
    ).select(
        "session_id", "turn_index", F.when(F.col("turn_index") == 0, "user").otherwise("assistant").alias("role"), "ts",
        F.lit(0).alias("n"),
    )
    marked = messages.withColumn("part", part).unionByName(end.withColumn("part", F.lit(4)))
    log = _in_order(spark, marked, F.col("part"), 5)
    starts = log.filter("role = 'user'").select(
        F.concat_ws(":", "session_id", "turn_index").alias("run_id"), "session_id",
        F.col("ts").alias("started_at"), F.col("n").alias("request"),
    )
    tool = F.col("role") == "tool"
    ends = log.filter("role <> 'user'").select(
        F.concat_ws(":", "session_id", F.col("turn_index") - 1).alias("run_id"), F.col("ts").alias("ended_at"),
        F.when(~tool, F.col("n")).alias("response"), F.when(tool, F.lit("tool")).alias("error"),
    )
    done = _to_table(jobs.paired_calls(starts, ends, "10 minutes"), _folder(spark))
    return done.filter(F.col("session_id") != _NO_SESSION)


UNMATCHED_SQL = f"""WITH {Q.CONV}
SELECT s.session_id || ':' || s.turn_index AS run_id, s.session_id, s.ts AS started_at,
  length(s.content) AS request, e.ts AS ended_at,
  CASE WHEN e.role <> 'tool' THEN length(e.content) END AS response,
  CASE WHEN e.role = 'tool' THEN 'tool' END AS error, e.session_id IS NOT NULL AS matched
FROM conv s LEFT JOIN conv e ON s.session_id = e.session_id AND e.turn_index = s.turn_index + 1 AND e.role <> 'user'
WHERE s.role = 'user'"""


def stream_late_signals(spark, sf_dir):
    """The third turn of every third session comes after all others: it is late, is neither numbered nor
    chained, and its signal is found all the same."""
    content = ["session_id", "turn_index", "role", "content"]
    messages = overlay.conversations(spark, sf_dir).withColumn("digest", chain.content_digest(content)).withColumn(
        "event_id", F.concat_ws(":", "session_id", "turn_index")
    )
    last = messages.groupBy("session_id").agg(F.max("turn_index").alias("last"))
    late = (F.col("session_id").cast("long") % 3 == 0) & (F.col("turn_index") == 2) & (F.col("last") >= 4)
    marked = written(messages.join(last, "session_id").withColumn("part", late.cast("int")), "late-messages")
    sink = TurnSink(f"{_folder(spark)}/tables")
    given = jobs.session_turns(_in_order(spark, marked, F.col("part"), 2), late_seconds=60)
    _finish(given.writeStream.foreachBatch(sink), _folder(spark))
    found = sink.read(spark, "signals").filter("turn_index IS NULL")
    missed = sink.read(spark, "late").select("session_id", "event_id")
    chained = sink.read(spark, "chain").groupBy("session_id").agg(F.count(F.lit(1)).alias("chained"))
    return (
        missed.join(found.select("session_id", "score", F.array_join("matched_heuristics", ",").alias("rules"),
                                 "evidence_snippet"), "session_id", "left")
        .join(chained, "session_id")
    )


LATE_SQL = f"""WITH {Q.MESSAGE_SIGNALS},
n AS (SELECT session_id, max(turn_index) AS last, count(*) AS turns FROM conv GROUP BY 1),
late AS (SELECT session_id, turns FROM n WHERE CAST(session_id AS BIGINT) % 3 = 0 AND last >= 4)
SELECT l.session_id, l.session_id || ':2' AS event_id, m.score, m.rules, m.ev AS evidence_snippet, turns - 1 AS chained
FROM late l LEFT JOIN msg m ON m.session_id = l.session_id AND m.turn_index = 2"""


def stream_campaigns(spark, sf_dir):
    """Signals streamed through the sink: campaign matches of the alerts."""
    folder = _folder(spark)
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    seconds = F.col("session_id").cast("long") * 3600 + F.col("turn_index") * 60
    signals = jobs.turn_signals(_turns(spark, sf_dir)).withColumns(
        {
            "signal_id": F.concat_ws(
                ":", "session_id", F.col("turn_index").cast("string"), "stage"
            ),
            "ts": F.timestamp_seconds(F.unix_seconds(start) + seconds),
        }
    )
    sink = SignalSink(f"{folder}/tables")
    _finish(signals.writeStream.foreachBatch(sink), folder)
    alerts = spark.read.parquet(sink.path("alerts"))
    return alerts.select(
        "signal_id", "score", "fingerprint_id", "matched",
        F.col("campaign_match.hit_count").alias("hit_count"),
    )


STREAM_CAMPAIGNS_SQL = f"""WITH RECURSIVE {ASSIGNED}
SELECT a.signal_id, r.score, a.fingerprint_id, a.matched,
  CASE WHEN a.matched THEN row_number() OVER (PARTITION BY a.fingerprint_id
    ORDER BY a.ts, a.signal_id) END AS hit_count
FROM assigned a JOIN raised r USING (signal_id)"""


QUERIES = {
    "stream_turn_signals": (stream_turn_signals, TURN_SIGNALS_SQL),
    "stream_windows": (stream_windows, STREAM_WINDOWS_SQL),
    "stream_chain": (stream_chain, STREAM_CHAIN_SQL),
    "stream_continued_chain": (stream_continued_chain, STREAM_CONTINUED_SQL),
    "stream_running_max": (stream_running_max, STREAM_MAX_SQL),
    "stream_unique_events": (stream_unique_events, UNIQUE_SQL),
    "stream_pairs": (stream_pairs, PAIRS_SQL),
    "stream_unmatched": (stream_unmatched, UNMATCHED_SQL),
    "stream_late_signals": (stream_late_signals, LATE_SQL),
    "stream_campaigns": (stream_campaigns, STREAM_CAMPAIGNS_SQL),
}
