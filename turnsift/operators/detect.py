"""Scanning rows of text and turning messages into signals."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from turnsift.config import ScanConfig
from turnsift.functions import rules as R
from turnsift.functions import scoring, text as X
from turnsift.functions.rules import RULES, Rule
from turnsift.operators.suppress import drop_false_alarms

Scorer = Callable[[DataFrame, str], DataFrame]
"""Adds a DOUBLE ``ml_score`` column for the named text column."""

SKIPPED_LANGUAGE_IDS = (
    "binary", "image", "pdf", "notebook", "git-commit", "git-rebase",
)


def with_scan(
    df: DataFrame,
    text: str,
    cfg: ScanConfig = ScanConfig(),
    rules: Sequence[Rule] = RULES,
    scorer: Scorer | None = None,
) -> DataFrame:
    """Add rule_mask, h_points, ib_points and the averaged (or model-weighted) score."""
    scanned = R.with_rule_mask(df, text, rules)
    scanned = scanned.withColumns(
        {"h_points": R.heuristic_points(rules=rules), "ib_points": R.boundary_points(rules=rules)}
    )
    if scorer is not None and cfg.use_model:
        scanned = scorer(scanned, text)
        score = scoring.with_model(F.col("h_points"), F.col("ib_points"), F.col("ml_score"))
    else:
        score = scoring.averaged(F.col("h_points"), F.col("ib_points"))
    return scanned.withColumn("score", score)


def is_scannable(
    text: Column, language_id: Column | None = None, cfg: ScanConfig = ScanConfig()
) -> Column:
    """Gate of the document scan: not too long, not blank, not a skipped kind."""
    passes = (F.length(text) <= cfg.max_scan_chars) & ~X.is_blank(text)
    if language_id is not None:
        passes = passes & ~F.coalesce(language_id, F.lit("")).isin(*SKIPPED_LANGUAGE_IDS)
    return passes


def explode_events(events: DataFrame) -> DataFrame:
    """One row per message of every event's context window, with the event's sources."""
    return events.select(
        "session_id",
        "turn_index",
        F.posexplode("messages_in").alias("msg_index", "_message"),
        F.col("external_sources").alias("sources"),
    ).select(
        "session_id",
        "turn_index",
        "msg_index",
        F.col("_message.role").alias("role"),
        F.col("_message.content").alias("content"),
        "sources",
    )


def with_own_sources(messages: DataFrame) -> DataFrame:
    """For flat logs (a message is its turn): sources found in the message itself."""
    from_text = X.external_sources(F.array("content"))
    none = F.array().cast("array<string>")
    return messages.withColumn(
        "sources", F.when(F.col("role").isin("user", "tool"), from_text).otherwise(none)
    )


def external_only(messages: DataFrame) -> DataFrame:
    return messages.filter(
        F.col("content").isNotNull()
        & (F.col("content") != "")
        & X.is_external(F.col("role"), F.col("content"))
    )


def message_signals(
    messages: DataFrame,
    cfg: ScanConfig = ScanConfig(),
    rules: Sequence[Rule] = RULES,
    scorer: Scorer | None = None,
    approved: DataFrame | None = None,
) -> DataFrame:
    """Signals of external messages; needs session_id, turn_index, msg_index, role,
    content, sources. Evidence is cut only for the rows that pass the threshold."""
    scanned = with_scan(external_only(messages), "content", cfg, rules, scorer)
    flagged = scanned.filter(F.col("score") >= cfg.threshold)
    if approved is not None:
        flagged = drop_false_alarms(flagged, "content", approved, cfg)
    ids = R.rule_ids(rules=rules)
    return flagged.select(
        "session_id",
        "turn_index",
        "msg_index",
        F.lit("message").alias("stage"),
        "score",
        F.when(F.size(ids) > 0, ids).otherwise(F.array(F.lit("ML only"))).alias(
            "matched_heuristics"
        ),
        X.first_source(F.col("content"), F.col("sources")).alias("source"),
        R.evidence("content", rules=rules).alias("evidence_snippet"),
    )


def text_check(
    df: DataFrame,
    text: str,
    cfg: ScanConfig = ScanConfig(),
    rules: Sequence[Rule] = RULES,
    scorer: Scorer | None = None,
) -> DataFrame:
    """Averaged score with its components, verdict, rules and up to 300 evidence chars."""
    scanned = with_scan(df, text, cfg, rules, scorer)
    hit = F.when(R.has_hit(rules=rules), F.left(R.evidence(text, rules=rules), F.lit(300)))
    model = F.round("ml_score", 3) if "ml_score" in scanned.columns else F.lit(None).cast("double")
    return scanned.withColumns(
        {
            "verdict": scoring.three_way(F.col("score"), cfg.threshold, cfg.compromised_at),
            "injection_detected": F.col("score") >= cfg.threshold,
            "heuristic_score": F.round(F.col("h_points") / 100.0, 3),
            "ml_score": model,
            "boundary_score": F.round(F.col("ib_points") / 100.0, 3),
            "matched_patterns": R.rule_ids(rules=rules),
            "evidence": F.coalesce(hit, F.lit("")),
        }
    )


def text_scan(
    df: DataFrame, text: str, rules: Sequence[Rule] = RULES, scorer: Scorer | None = None
) -> DataFrame:
    """Corpus scan: additive score, verdict at 0.25 / 0.75, evidence up to 500 chars."""
    scanned = R.with_rule_mask(df, text, rules)
    model = None
    if scorer is not None:
        scanned = scorer(scanned, text)
        model = F.col("ml_score")
    scanned = scanned.withColumn(
        "score",
        scoring.additive(
            R.heuristic_points(rules=rules), R.boundary_points(rules=rules), model
        ),
    )
    hit = F.when(R.has_hit(rules=rules), R.evidence(text, rules=rules))
    return scanned.withColumns(
        {
            "verdict": scoring.three_way(F.col("score")),
            "matched_heuristics": R.rule_ids(rules=rules),
            "evidence_snippet": F.coalesce(hit, F.lit("")),
        }
    )


def page_scan(
    pages: DataFrame,
    html: str = "html",
    cfg: ScanConfig = ScanConfig(),
    rules: Sequence[Rule] = RULES,
    scorer: Scorer | None = None,
) -> DataFrame:
    """Check of raw HTML, comments and hidden elements included, with the page title."""
    checked = text_check(pages, html, cfg, rules, scorer)
    return checked.withColumn("page_title", X.page_title(F.col(html)))


def scan_signals(scans: DataFrame, source: str, evidence: str, rules: str) -> DataFrame:
    """Signals table rows for the non-clean rows of a scan; ids are functions of the row."""
    ids = F.col(rules)
    return scans.filter(F.col("verdict") != scoring.CLEAN).select(
        F.sha2(F.concat_ws("\x1f", F.lit("scan"), source, evidence), 256).alias("session_id"),
        F.lit(0).alias("turn_index"),
        F.lit(0).alias("msg_index"),
        F.lit("scan").alias("stage"),
        "score",
        F.when(F.size(ids) > 0, ids).otherwise(F.array(F.lit("scan"))).alias(
            "matched_heuristics"
        ),
        F.col(source).alias("source"),
        F.col(evidence).alias("evidence_snippet"),
    )
