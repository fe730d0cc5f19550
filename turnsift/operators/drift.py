"""Question / response drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from turnsift.config import ScanConfig
from turnsift.functions import scoring, text as X
from turnsift.functions.grams import cosine, text_similarity


def with_drift(
    pairs: DataFrame,
    question: str,
    response: str,
    cfg: ScanConfig = ScanConfig(),
    vectors: tuple[str, str] | None = None,
) -> DataFrame:
    """Add similarity and drift_score; blank text counts as on topic.

    ``vectors`` names two embedding columns of the caller's own model; without them the
    similarity is that of the hashed character grams.
    """
    blank = X.is_blank(F.col(question)) | X.is_blank(F.col(response))
    if vectors:
        similarity = cosine(F.col(vectors[0]), F.col(vectors[1]))
    else:
        similarity = text_similarity(
            F.when(~blank, F.col(question)), F.when(~blank, F.col(response))
        )
    compared = pairs.withColumn("similarity", F.when(~blank, similarity))
    score = scoring.drift_score(F.col("similarity"), cfg.drift_floor, cfg.clamp_drift)
    return compared.withColumn("drift_score", F.coalesce(score, F.lit(0.0)))


def event_pairs(events: DataFrame) -> DataFrame:
    """Last user message of every event against its output."""
    users = F.filter("messages_in", lambda m: m["role"] == "user")
    return events.select(
        "session_id",
        "turn_index",
        F.try_element_at(users, F.lit(-1))["content"].alias("question"),
        F.coalesce(F.col("message_out.content"), F.lit("")).alias("response"),
    ).filter(F.col("question").isNotNull())


def drift_signals(
    pairs: DataFrame, cfg: ScanConfig = ScanConfig(), vectors: tuple[str, str] | None = None
) -> DataFrame:
    """SEM01 signals; ``pairs`` has session_id, turn_index, question, response."""
    scored = with_drift(pairs, "question", "response", cfg, vectors)
    return scored.filter(F.col("drift_score") >= cfg.threshold).select(
        "session_id",
        "turn_index",
        F.lit(None).cast("int").alias("msg_index"),
        F.lit("drift").alias("stage"),
        F.col("drift_score").alias("score"),
        F.array(F.lit("SEM01")).alias("matched_heuristics"),
        F.lit(None).cast("string").alias("source"),
        F.concat(
            F.lit("Low semantic similarity between question and response (score="),
            F.format_number("drift_score", 3),
            F.lit(") — response may be unrelated to original request."),
        ).alias("evidence_snippet"),
    )
