"""Session-level tables: metadata, listing, status, purge, append, timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnsift.config import ScanConfig
from turnsift.functions import scoring, text as X
from turnsift.operators.ordered import CHUNK_ROWS, chunk_of, with_running

STAGES = ("message", "drift", "window", "scan")


def signal_order() -> Column:
    """Order in which the signals of a session were raised."""
    stage = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage")).cast("int")
    return F.struct(
        F.col("turn_index").alias("turn_index"),
        stage.alias("stage"),
        F.coalesce(F.col("msg_index"), F.lit(0)).cast("long").alias("msg_index"),
    )


def _strongest() -> Column:
    """Sort key of the highest score, the earliest signal among equals."""
    order = signal_order()
    return F.struct(
        F.col("score"), -order["turn_index"], -order["stage"], -order["msg_index"]
    )


def session_meta(events: DataFrame) -> DataFrame:
    """First stored event of a session gives its start, model and agent."""
    first = F.min_by(F.struct("timestamp", "model", "agent_name"), F.struct("timestamp", "turn_index"))
    return (
        events.groupBy("session_id")
        .agg(first.alias("_first"), F.count(F.lit(1)).alias("turn_count"))
        .select(
            "session_id",
            F.col("_first.timestamp").alias("started_at"),
            F.col("_first.model").alias("model"),
            F.col("_first.agent_name").alias("agent_name"),
            "turn_count",
        )
    )


def signal_summary(signals: DataFrame) -> DataFrame:
    """Per session: number of signals, highest score, and the signal that holds it."""
    top = F.max_by(F.struct("turn_index", "source"), _strongest())
    return (
        signals.groupBy("session_id")
        .agg(
            F.count(F.lit(1)).alias("signal_count"),
            F.max("score").alias("max_signal_score"),
            top.alias("_top"),
        )
        .select(
            "session_id",
            "signal_count",
            "max_signal_score",
            F.col("_top.turn_index").alias("top_turn"),
            F.col("_top.source").alias("top_source"),
        )
    )


def list_sessions(events: DataFrame, signals: DataFrame) -> DataFrame:
    """All sessions with verdict and top source; sort by started_at to show the latest."""
    listed = session_meta(events).join(signal_summary(signals), "session_id", "left")
    verdict = scoring.three_way(F.coalesce("max_signal_score", F.lit(0.0)))
    return listed.withColumn("verdict", verdict).drop("signal_count", "top_turn")


def session_status(events: DataFrame, signals: DataFrame) -> DataFrame:
    turns = events.groupBy("session_id").agg(F.count(F.lit(1)).alias("turn_count"))
    found = signals.groupBy("session_id").agg(
        F.max("score").alias("_max"), F.count(F.lit(1)).alias("_n")
    )
    score = F.coalesce("_max", F.lit(0.0))
    return turns.join(found, "session_id", "left").select(
        "session_id",
        scoring.three_way(score).alias("verdict"),
        F.round(score, 3).alias("score"),
        "turn_count",
        F.coalesce("_n", F.lit(0)).alias("signal_count"),
    )


def session_verdicts(session_ids: DataFrame, signals: DataFrame) -> DataFrame:
    """Verdict of every session from its highest signal."""
    best = signals.groupBy("session_id").agg(F.max("score").alias("_max"))
    score = F.coalesce("_max", F.lit(0.0))
    return (
        session_ids.select("session_id")
        .distinct()
        .join(best, "session_id", "left")
        .select("session_id", score.alias("max_score"), scoring.three_way(score).alias("verdict"))
    )


def best_per_turn(signals: DataFrame) -> DataFrame:
    """Highest signal of every turn, the first one among equals."""
    return (
        signals.groupBy("session_id", "turn_index")
        .agg(F.max_by(F.struct("score", "stage", "source"), _strongest()).alias("_best"))
        .select("session_id", "turn_index", "_best.score", "_best.stage", "_best.source")
    )


def running_max(signals: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Highest score of the session up to every turn that has a signal."""
    per_turn = signals.groupBy("session_id", "turn_index").agg(F.max("score").alias("score"))
    return with_running(
        per_turn, ["session_id"], ["turn_index"],
        chunk_of(F.col("turn_index"), chunk_rows), {"max_so_far": (F.max, F.col("score"))},
    )


def with_rejections(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Add ``rejected`` and ``copies``: an event_id that is stored already, or that is not
    the first of its id in the batch by (timestamp, session_id, turn_index), is rejected.

    Equal rows are counted before they are shuffled, so an event that was sent a million
    times is one row here with its number of copies.
    """
    columns = incoming.columns
    order = F.struct(
        "timestamp", "session_id", "turn_index",
        F.sha2(F.to_json(F.struct(*columns)), 256).alias("content"),
    )
    versions = incoming.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    versions = versions.withColumn("_order", order)
    first = versions.groupBy("event_id").agg(F.min("_order").alias("_first"))
    known = stored.select("event_id").distinct().withColumn("_known", F.lit(True))
    marked = versions.join(first, "event_id").join(known, "event_id", "left")

    def outcome(rejected: bool, copies: Column) -> Column:
        return F.struct(F.lit(rejected).alias("rejected"), copies.alias("copies"))

    copies = F.col("_copies")
    one = F.lit(1).cast("long")
    kept = F.array_compact(
        F.array(outcome(False, one), F.when(copies > 1, outcome(True, copies - 1)))
    )
    is_new = F.col("_known").isNull() & (F.col("_order") == F.col("_first"))
    outcomes = F.when(is_new, kept).otherwise(F.array(outcome(True, copies)))
    return marked.select(*columns, F.inline(outcomes))


def split_new_events(stored: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of a batch; rejected rows say how many copies."""
    marked = with_rejections(stored, incoming)
    return marked.filter(~F.col("rejected")).drop("rejected", "copies"), marked.filter(
        "rejected"
    ).drop("rejected")


def purge_sessions(table: DataFrame, session_ids: DataFrame) -> DataFrame:
    """Rows of all other sessions; write the result as the new table."""
    return table.join(session_ids.select("session_id").distinct(), "session_id", "left_anti")


def timeline(turns: DataFrame, signals: DataFrame) -> DataFrame:
    """One row per turn: model, message previews, tool names, best signal, highlight.

    ``turns``: session_id, turn_index, model, messages (array of role, content), tools.
    """
    previews = F.transform(
        "messages",
        lambda m: F.concat(F.lit("["), m["role"], F.lit("] "), X.preview(m["content"], 200)),
    )
    shown = turns.select(
        "session_id", "turn_index", "model", previews.alias("previews"), "tools"
    ).join(
        best_per_turn(signals).select("session_id", "turn_index", "score"),
        ["session_id", "turn_index"],
        "left",
    )
    mark = F.when(F.col("score") >= 0.65, "red").when(F.col("score").isNotNull(), "amber")
    return shown.withColumn("highlight", F.coalesce(mark, F.lit("none")))


def turns_without_signal(turns: DataFrame, signals: DataFrame) -> DataFrame:
    flagged = signals.select("session_id", "turn_index").distinct().withColumn("flagged", F.lit(True))
    joined = turns.join(flagged, ["session_id", "turn_index"], "left")
    return joined.withColumn("flagged", F.coalesce("flagged", F.lit(False)))


def above_threshold(signals: DataFrame, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    return signals.filter(F.col("score") >= cfg.threshold)
