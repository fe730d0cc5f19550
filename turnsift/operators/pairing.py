"""Joining start and end records of calls, and numbering the turns of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnsift.operators.ordered import chunk_of, with_previous, with_rank


def pair_by_run(starts: DataFrame, ends: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Start and end records with the same run_id; an end without start is dropped, an
    error drops its start. Both sides may repeat a run_id: the last start by ts and the
    first end count.

    starts: run_id, session_id, ts, request; ends: run_id, ts, response; errors: run_id.
    """
    first_start = starts.groupBy("run_id").agg(
        F.max_by(
            F.struct("session_id", F.col("ts").alias("started_at"), "request"),
            F.struct("ts", "request"),
        ).alias("_start")
    )
    first_end = ends.groupBy("run_id").agg(
        F.min_by(F.struct(F.col("ts").alias("ended_at"), "response"), F.struct("ts", "response"))
        .alias("_end")
    )
    if errors is not None:
        first_start = first_start.join(errors.select("run_id"), "run_id", "left_anti")
    return first_start.join(first_end, "run_id").select("run_id", "_start.*", "_end.*")


def pair_in_session(
    log: DataFrame, chunk: Column | None = None, keep_unmatched: bool = True
) -> DataFrame:
    """Pairs by session instead of run id: an end takes the start right before it.

    log: session_id, ts, seq, kind (start | end | error), text. A later start replaces a
    waiting one; an end or error uses it up. An end without a waiting start keeps an
    empty request unless ``keep_unmatched`` is off.
    """
    if chunk is None:  # by rank, so that a burst within a second is split like any other rows
        log, chunk = with_rank(log, ["session_id"], ["ts", "seq"], "_nth"), chunk_of(F.col("_nth"))
    linked = with_previous(log, ["session_id"], ["ts", "seq"], chunk, ["kind", "text", "ts"])
    waiting = F.col("previous.kind").eqNullSafe("start")
    pairs = linked.filter(F.col("kind") == "end").select(
        "session_id",
        F.when(waiting, F.col("previous.ts")).alias("started_at"),
        F.col("ts").alias("ended_at"),
        "seq",
        F.when(waiting, F.col("previous.text")).otherwise(F.lit("")).alias("request"),
        F.col("text").alias("response"),
        waiting.alias("matched"),
    )
    return pairs if keep_unmatched else pairs.filter("matched")


def number_turns(events: DataFrame, last_turns: DataFrame | None = None) -> DataFrame:
    """turn_index of new events by (ts, event_id), continuing after the last stored turn.

    last_turns: session_id, last_turn.
    """
    placed = with_rank(events, ["session_id"], ["ts", "event_id"], "_nth")
    if last_turns is None:
        return placed.withColumn("turn_index", F.col("_nth").cast("int")).drop("_nth")
    known = placed.join(last_turns.select("session_id", "last_turn"), "session_id", "left")
    offset = F.coalesce(F.col("last_turn") + 1, F.lit(0))
    return known.withColumn("turn_index", (offset + F.col("_nth")).cast("int")).drop(
        "_nth", "last_turn"
    )
