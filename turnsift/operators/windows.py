"""Sliding window over the last turns of a session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from turnsift.config import ScanConfig
from turnsift.functions import rules as R
from turnsift.functions import text as X
from turnsift.functions.rules import RULES, Rule
from turnsift.operators.detect import Scorer, with_own_sources, with_scan
from turnsift.operators.ordered import CHUNK_ROWS, chunk_of, with_last_rows
from turnsift.operators.suppress import unflag_false_alarms

TURN_JOIN = "\n\n---\n\n"


def turn_windows(
    turns: DataFrame,
    size: int,
    order: Sequence[str] = ("turn_index",),
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """For every turn the external texts and sources of the last ``size`` turns.

    ``turns`` has one row per stored turn: session_id, turn_index, ext_texts
    array<string>, sources array<string>; other columns are kept. Long sessions are
    cut into chunks that hand on their last size - 1 turns.
    """
    last = with_last_rows(
        turns, ["session_id"], order, chunk_of(F.col("turn_index"), chunk_rows), ["ext_texts", "sources"], size, "_last"
    )
    return last.withColumns(
        {
            "window_texts": F.flatten(F.array_compact(F.transform("_last", lambda r: r["ext_texts"]))),
            "window_sources": F.flatten(F.array_compact(F.transform("_last", lambda r: r["sources"]))),
            "window_size": F.size("_last").cast("long"),
        }
    ).drop("_last")


def window_signals(
    turns: DataFrame,
    cfg: ScanConfig = ScanConfig(),
    rules: Sequence[Rule] = RULES,
    scorer: Scorer | None = None,
    order: Sequence[str] = ("turn_index",),
    exclude_flagged_turns: bool = False,
) -> DataFrame:
    """Signals of turns that have none of their own but whose window has one.

    ``turns`` also has BOOLEAN ``flagged`` (the turn already has a signal). A flagged turn
    stays in the windows after it unless ``exclude_flagged_turns``.
    """
    if cfg.window_turns < 2:
        return window_signals(turns.limit(0), ScanConfig(), rules, scorer, order)
    kept = turns
    if exclude_flagged_turns:
        empty = F.array().cast("array<string>")
        kept = turns.withColumn("ext_texts", F.when(F.col("flagged"), empty).otherwise(F.col("ext_texts")))
    windows = turn_windows(kept, cfg.window_turns, order).filter(
        ~F.col("flagged") & (F.col("window_size") >= 2) & (F.size("window_texts") > 0)
    )
    blocks = windows.select(
        "session_id",
        "turn_index",
        "window_size",
        F.array_distinct("window_sources").alias("window_sources"),
        F.array_join("window_texts", TURN_JOIN).alias("block"),
    )
    hits = with_scan(blocks, "block", cfg, rules, scorer).filter(F.col("score") >= cfg.threshold)
    ids = R.rule_ids(rules=rules)
    head = F.concat(F.lit("[Window "), F.col("window_size").cast("string"), F.lit(" turns] "))
    return hits.select(
        "session_id",
        "turn_index",
        F.lit(None).cast("int").alias("msg_index"),
        F.lit("window").alias("stage"),
        "score",
        F.concat(
            F.when(F.size(ids) > 0, ids).otherwise(F.array(F.lit("WIN_ML"))),
            F.array(F.lit("WIN01")),
        ).alias("matched_heuristics"),
        X.first_source(F.col("block"), F.col("window_sources")).alias("source"),
        F.concat(head, F.left(R.evidence("block", rules=rules), F.lit(460))).alias(
            "evidence_snippet"
        ),
    )


def flat_signals(
    messages: DataFrame,
    cfg: ScanConfig = ScanConfig(),
    rules: Sequence[Rule] = RULES,
    scorer: Scorer | None = None,
    approved: DataFrame | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Message and window signals of a log with one message per turn, in one pass.

    Every message is scanned where it is read; the turns then meet their window in one shuffle of
    texts (see ``with_last_rows``), and only the turns without a signal of their own are scanned again as a block.
    ``messages``: session_id, turn_index, role, content.
    """
    slim = with_own_sources(messages).select(
        "session_id",
        "turn_index",
        F.when(
            (F.col("content") != "") & X.is_external(F.col("role"), F.col("content")),
            F.col("content"),
        ).alias("own_text"),
        "sources",
    )
    own = with_scan(slim, "own_text", cfg, rules, scorer)
    own = own.withColumn("flagged", own["own_text"].isNotNull() & (F.col("score") >= cfg.threshold))
    if approved is not None:
        own = unflag_false_alarms(own, "own_text", approved, cfg)
    own = own.select(
        "session_id", "turn_index", "own_text", "sources", "flagged",
        F.col("rule_mask").alias("own_mask"), F.col("score").alias("own_score"),
    )
    last = with_last_rows(
        own, ["session_id"], ["turn_index"], chunk_of(F.col("turn_index"), chunk_rows),
        ["own_text", "sources"], max(cfg.window_turns, 1), "_last", messages.select("session_id", "turn_index"),
    )
    seen = last.withColumns(
        {
            "_texts": F.array_compact(F.transform("_last", lambda r: r["own_text"])),
            "_sources": F.flatten(F.array_compact(F.transform("_last", lambda r: r["sources"]))),
            "_size": F.size("_last") if cfg.window_turns >= 2 else F.lit(1),
        }
    ).drop("_last")
    return window_or_own_signals(seen, cfg, rules, scorer)


def window_or_own_signals(
    seen: DataFrame,
    cfg: ScanConfig = ScanConfig(),
    rules: Sequence[Rule] = RULES,
    scorer: Scorer | None = None,
) -> DataFrame:
    """A flagged turn's own signal, or that of its window.

    ``seen``: session_id, turn_index, own_text, own_mask, own_score, flagged, sources and
    the window as _texts, _sources, _size.
    """
    blocks = seen.withColumn(
        "block",
        F.when(
            ~F.col("flagged") & (F.col("_size") >= 2) & (F.size("_texts") > 0),
            F.array_join("_texts", TURN_JOIN),
        ),
    ).select(
        "session_id", "turn_index", "flagged", "own_mask", "own_score", "block",
        F.coalesce("block", "own_text").alias("text"),
        F.when(F.col("flagged"), F.col("sources"))
        .otherwise(F.array_distinct("_sources"))
        .alias("sources"),
        F.col("_size").alias("window_size"),
    ).filter(F.col("flagged") | F.col("block").isNotNull())
    scanned = with_scan(blocks, "block", cfg, rules, scorer)
    flagged = F.col("flagged")
    score = F.when(flagged, F.col("own_score")).otherwise(F.col("score"))
    mask = F.when(flagged, F.col("own_mask")).otherwise(F.col("rule_mask"))
    hits = scanned.withColumns({"_score": score, "_mask": mask}).filter(
        F.col("_score") >= cfg.threshold
    )
    ids = R.rule_ids("_mask", rules)
    named = F.when(F.size(ids) > 0, ids)
    found = R.evidence("text", "_mask", rules)
    head = F.concat(F.lit("[Window "), F.col("window_size").cast("string"), F.lit(" turns] "))
    return hits.select(
        "session_id",
        "turn_index",
        F.when(flagged, F.lit(0)).alias("msg_index"),
        F.when(flagged, "message").otherwise("window").alias("stage"),
        F.col("_score").alias("score"),
        F.when(flagged, F.coalesce(named, F.array(F.lit("ML only"))))
        .otherwise(F.concat(F.coalesce(named, F.array(F.lit("WIN_ML"))), F.array(F.lit("WIN01"))))
        .alias("matched_heuristics"),
        X.first_source(F.col("text"), F.col("sources")).alias("source"),
        F.when(flagged, found)
        .otherwise(F.concat(head, F.left(found, F.lit(460))))
        .alias("evidence_snippet"),
    )
