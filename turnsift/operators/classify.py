"""All stages over event-shaped input: messages, drift, and the window where both are silent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from turnsift.config import ScanConfig
from turnsift.functions import text as X
from turnsift.functions.rules import RULES, Rule
from turnsift.operators.detect import Scorer, explode_events, message_signals
from turnsift.operators.drift import drift_signals, event_pairs
from turnsift.operators.durable import written
from turnsift.operators.windows import window_signals


def event_turns(events: DataFrame) -> DataFrame:
    """session_id, turn_index, ext_texts, sources: what an event gives to its windows."""
    external = F.filter(
        "messages_in",
        lambda m: m["content"].isNotNull() & (m["content"] != "") & X.is_external(m["role"], m["content"]),
    )
    none = F.array().cast("array<string>")
    return events.select(
        "session_id", "turn_index",
        F.coalesce(F.transform(external, lambda m: m["content"]), none).alias("ext_texts"),
        F.coalesce("external_sources", none).alias("sources"),
    )


def classify(
    events: DataFrame,
    cfg: ScanConfig = ScanConfig(),
    rules: Sequence[Rule] = RULES,
    scorer: Scorer | None = None,
    approved: DataFrame | None = None,
    vectors: tuple[str, str] | None = None,
) -> DataFrame:
    """Signals of events (session_id, turn_index, messages_in, message_out, external_sources).

    External messages are scored and pass the false-alarm gate of the ``approved`` fingerprints;
    the answer is compared with the last question; an event with neither signal is scored
    together with the turns before it. Events without session_id are a session of their own.
    """
    messages = message_signals(explode_events(events), cfg, rules, scorer, approved)
    strays = drift_signals(event_pairs(events), cfg, vectors)
    found = written(messages.unionByName(strays), "classified")
    raised = found.select(
        F.col("session_id").alias("_session"), F.col("turn_index").alias("_turn"), F.lit(True).alias("_raised")
    ).distinct()
    turns = event_turns(events).join(
        raised,
        [F.col("session_id").eqNullSafe(F.col("_session")), F.col("turn_index").eqNullSafe(F.col("_turn"))],
        "left",
    ).withColumn("flagged", F.coalesce("_raised", F.lit(False))).drop("_session", "_turn", "_raised")
    return found.unionByName(window_signals(turns, cfg, rules, scorer))
