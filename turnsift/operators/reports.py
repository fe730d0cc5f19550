"""One report row per session; signals, diffs and matches stay in their own tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnsift.functions import scoring
from turnsift.operators.behavior import new_actions
from turnsift.operators.sessions import signal_summary

_NAMED = 5


def top_diffs(diffs: DataFrame) -> DataFrame:
    """Per session the number of diffs and the one with the highest anomaly (earliest pivot)."""
    lead = F.max_by(
        F.struct("pivot_turn", "n_new"), F.struct(F.col("anomaly_score"), -F.col("pivot_turn"))
    )
    return (
        diffs.groupBy("session_id")
        .agg(
            F.count(F.lit(1)).alias("diff_count"),
            F.max("anomaly_score").alias("max_anomaly"),
            lead.alias("_lead"),
        )
        .select(
            "session_id", "diff_count", "max_anomaly",
            F.col("_lead.pivot_turn").alias("pivot_turn"), F.col("_lead.n_new").alias("n_new"),
        )
    )


def leading_actions(tops: DataFrame, calls: DataFrame) -> DataFrame:
    """The first five new tools after the pivot of a session's top diff; the rank limit
    keeps at most five rows per session before they are shuffled."""
    first = Window.partitionBy("session_id").orderBy("first_turn", "first_call", "name")
    kept = (
        new_actions(tops, calls)
        .withColumn("_nth", F.row_number().over(first))
        .filter(F.col("_nth") <= _NAMED)
    )
    names = F.transform(
        F.array_sort(F.collect_list(F.struct("_nth", "name"))), lambda key: key["name"]
    )
    return kept.groupBy("session_id").agg(names.alias("lead_actions"))


def _money(score: Column) -> Column:
    """Two decimals, rounding the exact binary value half to even."""
    return F.format_number(score, 2)


def summary_text() -> Column:
    """Plain-language summary of a report row; the sentences are fixed values."""
    short = F.concat(F.left("session_id", F.lit(12)), F.lit("…"))
    turns = F.col("total_turns").cast("string")
    chain = F.when(F.col("chain_valid"), "Hash chain verified.").otherwise(
        "WARNING: hash chain integrity check failed - trace may have been tampered with."
    )
    has_source = F.coalesce(F.col("top_source") != "", F.lit(False))
    clean = F.concat(
        F.lit("Session "), short, F.lit(" completed "), turns,
        F.lit(" turn(s) with no injection signals above threshold. "), chain,
    )
    behaviour = F.when(
        F.coalesce("diff_count", F.lit(0)) == 0,
        "Behaviour analysis did not confirm a significant action pivot.",
    ).otherwise(F.concat(F.lit("Behaviour anomaly score: "), _money(F.col("max_anomaly")), F.lit(".")))
    from_source = F.when(
        has_source, F.concat(F.lit(" from source '"), F.col("top_source"), F.lit("'"))
    ).otherwise("")
    suspicious = F.concat(
        F.lit("Session "), short, F.lit(" shows "), F.col("signal_count").cast("string"),
        F.lit(" potential injection signal(s) across "), turns,
        F.lit(" turn(s). Highest signal score "), _money(F.col("max_signal_score")),
        F.lit(" at turn "), F.col("top_turn").cast("string"), from_source, F.lit(". "),
        behaviour, F.lit(" "), chain,
    )
    listed = F.coalesce(F.array_join("lead_actions", ", "), F.lit(""))
    more = F.when(
        F.col("n_new") > _NAMED,
        F.concat(F.lit(" (+"), (F.col("n_new") - _NAMED).cast("string"), F.lit(" more)")),
    ).otherwise("")
    from_short = F.when(
        has_source, F.concat(F.lit(" from '"), F.col("top_source"), F.lit("'"))
    ).otherwise("")
    compromised = F.concat(
        F.lit("Session "), short, F.lit(" appears compromised. Injection signal score "),
        _money(F.col("max_signal_score")), F.lit(" detected at turn "),
        F.col("top_turn").cast("string"), from_short, F.lit(". After the pivot, "),
        F.col("n_new").cast("string"), F.lit(" new action(s) appeared ("),
        F.coalesce(F.nullif(listed, F.lit("")), F.lit("none")), more,
        F.lit(") with anomaly score "), _money(F.col("max_anomaly")), F.lit(". "), chain,
    )
    return (
        F.when(F.col("verdict") == scoring.CLEAN, clean)
        .when(F.col("verdict") == scoring.SUSPICIOUS, suspicious)
        .otherwise(compromised)
    )


def session_reports(
    chains: DataFrame,
    signals: DataFrame,
    diffs: DataFrame,
    calls: DataFrame,
    links: DataFrame | None = None,
) -> DataFrame:
    """Report rows for all sessions at once.

    chains: session_id, chain_valid, total_turns; links: fingerprint_id, session_id.
    """
    tops = top_diffs(diffs)
    report = (
        chains.join(signal_summary(signals), "session_id", "left")
        .join(tops, "session_id", "left")
        .join(leading_actions(tops, calls), "session_id", "left")
    )
    if links is None:
        report = report.withColumn("fingerprint_matches", F.lit(0).cast("long"))
    else:
        seen = links.groupBy("session_id").agg(F.count(F.lit(1)).alias("fingerprint_matches"))
        report = report.join(seen, "session_id", "left").withColumn(
            "fingerprint_matches", F.coalesce("fingerprint_matches", F.lit(0))
        )
    report = report.withColumns(
        {
            "signal_count": F.coalesce("signal_count", F.lit(0)),
            "verdict": scoring.report_verdict(F.col("max_signal_score"), F.col("max_anomaly")),
            "confidence": scoring.report_confidence(F.col("max_signal_score"), F.col("chain_valid")),
        }
    )
    return report.withColumn("summary", summary_text()).select(
        "session_id", "total_turns", "chain_valid", "signal_count",
        F.coalesce("diff_count", F.lit(0)).alias("diff_count"), "max_signal_score", "max_anomaly",
        "verdict", "confidence", "fingerprint_matches", "summary",
    )
