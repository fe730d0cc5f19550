"""Streaming jobs over message logs, built from the same columns as the batch operators."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from turnsift.config import ScanConfig
from turnsift.functions import scoring, text as X
from turnsift.functions.rules import RULES, Rule
from turnsift.operators.detect import Scorer, message_signals, with_own_sources, with_scan
from turnsift.operators.windows import window_or_own_signals


def read_log(
    spark: SparkSession, path: str, schema: StructType, glob: str | None = None,
    bytes_per_trigger: int = 1 << 30, files_per_trigger: int | None = None,
) -> DataFrame:
    """Parquet folder as a stream with a declared schema. The size of a micro-batch bounds
    what a single session can bring into one task of a keyed operator."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger is None:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    else:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def scan_messages(
    messages: DataFrame,
    cfg: ScanConfig = ScanConfig(),
    rules: Sequence[Rule] = RULES,
    scorer: Scorer | None = None,
) -> DataFrame:
    """Stateless: signals of every arriving message."""
    return message_signals(with_own_sources(messages), cfg, rules, scorer)


def unique_events(events: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Drop repeated event ids that arrive within the watermark."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["event_id"])


def running_scores(signals: DataFrame) -> DataFrame:
    """Highest score and verdict per session; run in update mode."""
    best = signals.groupBy("session_id").agg(F.max("score").alias("max_score"))
    return best.withColumn("verdict", scoring.three_way(F.col("max_score")))


def paired_calls(
    starts: DataFrame, ends: DataFrame, delay: str = "1 hour", longest: str = "1 hour"
) -> DataFrame:
    """Start records of runs with their end, if one comes within ``longest``; otherwise the
    start comes out alone (``matched`` false) once the watermark has passed.

    starts: run_id, session_id, started_at, request; ends: run_id, ended_at, response, and
    optionally error (a run that failed ends with an error and no response).
    """
    if "error" not in ends.columns:
        ends = ends.withColumn("error", F.lit(None).cast("string"))
    left = starts.withWatermark("started_at", delay).alias("s")
    right = ends.withWatermark("ended_at", delay).alias("e")
    same_run = F.expr(
        "s.run_id = e.run_id AND e.ended_at >= s.started_at "
        f"AND e.ended_at <= s.started_at + INTERVAL {longest}"
    )
    return left.join(right, same_run, "left_outer").select(
        "s.run_id", "s.session_id", "s.started_at", "s.request", "e.ended_at", "e.response",
        "e.error", F.col("e.run_id").isNotNull().alias("matched"),
    )


_TURN_OUT = (
    "session_id string, event_id string, turn_index int, prev_hash string, event_hash string, "
    "own_text string, sources array<string>, window_texts array<string>, "
    "window_sources array<string>, window_size int, late boolean"
)
_TURN_STATE = "next_turn int, last_hash string, newest long, ring string"


def session_turns(
    messages: DataFrame, cfg: ScanConfig = ScanConfig(), late_seconds: int = 3600
) -> DataFrame:
    """Number, chain and window the turns of every session as they arrive.

    messages: session_id, event_id, ts, role, content, digest. The state of a session is
    its next turn, last hash, newest time and the last ``window_turns`` external texts. A
    turn older than the newest one by more than ``late_seconds`` comes out with ``late``
    set and is neither numbered nor chained, so a sealed chain never changes.
    """
    size = max(cfg.window_turns, 1)
    slim = with_own_sources(messages).select(
        "session_id",
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"),
        F.when(
            (F.col("content") != "") & X.is_external(F.col("role"), F.col("content")),
            F.col("content"),
        ).alias("own_text"),
        "sources",
        "digest",
    )

    def advance(
        key: tuple, parts: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        turn, last, newest, ring = state.get if state.exists else (0, "", None, "[]")
        window = json.loads(ring)
        batch = pd.concat(list(parts)).sort_values(["micros", "event_id"], kind="stable")
        rows = []
        for row in batch.itertuples(index=False):
            sources = [] if row.sources is None else list(row.sources)
            text = row.own_text if isinstance(row.own_text, str) else None
            if newest is not None and row.micros < newest - late_seconds * 1_000_000:
                rows.append((key[0], row.event_id, None, None, None, text, sources, [], [], 0, True))
                continue
            window = (window + [[text, sources]])[-size:]
            previous, last = last, hashlib.sha256((last + row.digest).encode()).hexdigest()
            rows.append((
                key[0], row.event_id, turn, previous, last, text, sources,
                [t for t, _ in window if t is not None],
                [s for _, found in window for s in found],
                len(window), False,
            ))
            turn += 1
            newest = row.micros if newest is None else max(newest, row.micros)
        state.update((turn, last, newest, json.dumps(window)))
        yield pd.DataFrame(rows, columns=_COLUMNS).astype({"turn_index": "Int32"})

    return slim.groupBy("session_id").applyInPandasWithState(
        advance, _TURN_OUT, _TURN_STATE, "append", GroupStateTimeout.NoTimeout
    )


_COLUMNS = [part.split()[0] for part in _TURN_OUT.split(", ")]


def turn_signals(
    turns: DataFrame,
    cfg: ScanConfig = ScanConfig(),
    rules: Sequence[Rule] = RULES,
    scorer: Scorer | None = None,
) -> DataFrame:
    """Own and window signals of the turns that ``session_turns`` put out. A late turn has no
    number and no window, but its text is scanned: its signal has a null turn_index."""
    own = with_scan(turns, "own_text", cfg, rules, scorer)
    flagged = F.col("own_text").isNotNull() & (F.col("score") >= cfg.threshold)
    seen = own.select(
        "session_id", "turn_index", "own_text", "sources",
        flagged.alias("flagged"),
        F.col("rule_mask").alias("own_mask"),
        F.col("score").alias("own_score"),
        F.col("window_texts").alias("_texts"),
        F.col("window_sources").alias("_sources"),
        F.col("window_size").alias("_size"),
    )
    return window_or_own_signals(seen, cfg, rules, scorer)


def late_turns(turns: DataFrame) -> DataFrame:
    return turns.filter("late").select("session_id", "event_id", "own_text", "sources")
