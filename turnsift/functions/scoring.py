"""Score formulas and the verdict rules, each under its own name."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CLEAN, SUSPICIOUS, COMPROMISED = "clean", "suspicious", "compromised"


def averaged(h_points: Column, ib_points: Column) -> Column:
    """Both stages count half (no model)."""
    return F.round((h_points + ib_points) / F.lit(200.0), 4)


def with_model(h_points: Column, ib_points: Column, ml_score: Column) -> Column:
    """0.30 heuristics + 0.40 model + 0.30 boundary; without a model score, the average."""
    weighted = F.round((h_points + ib_points) * 0.003 + ml_score * 0.40, 4)
    return F.coalesce(weighted, averaged(h_points, ib_points))


def additive(h_points: Column, ib_points: Column, ml_score: Column | None = None) -> Column:
    """Capped sum used by plain text scans and detector evaluation."""
    base = F.least(h_points + ib_points, F.lit(100)) / F.lit(100.0)
    if ml_score is None:
        return base
    return F.least(F.lit(1.0), base + F.coalesce(ml_score, F.lit(0.0)) * 0.4)


def three_way(score: Column, suspicious_at: float = 0.25, compromised_at: float = 0.75) -> Column:
    """Verdict of a scan, a text check or a session's highest score."""
    return (
        F.when(score >= compromised_at, COMPROMISED)
        .when(score >= suspicious_at, SUSPICIOUS)
        .otherwise(CLEAN)
    )


def report_verdict(max_score: Column, max_anomaly: Column) -> Column:
    """Report rule: a strong signal is confirmed only by a changed tool behaviour."""
    confirmed = (max_score >= 0.65) & (F.coalesce(max_anomaly, F.lit(0.0)) >= 0.5)
    return (
        F.when(max_score.isNull(), CLEAN).when(confirmed, COMPROMISED).otherwise(SUSPICIOUS)
    )


def report_confidence(max_score: Column, chain_valid: Column) -> Column:
    trusted = chain_valid & max_score.isNotNull()
    return F.when(trusted, F.round(max_score, 4)).otherwise(F.lit(0.0))


def score_band(score: Column) -> Column:
    return F.when(score < 0.35, "green").when(score < 0.65, "amber").otherwise("red")


def editor_severity(score: Column) -> Column:
    return F.when(score < 0.20, "cleared").when(score >= 0.75, "error").otherwise("warning")


def drift_score(similarity: Column, floor: float = 0.20, clamp: bool = False) -> Column:
    """0 for an answer on topic, else rising as the similarity falls below the floor."""
    off_topic = F.round((F.lit(1.0) - similarity / floor) * 0.5, 4)
    if clamp:
        off_topic = F.least(off_topic, F.lit(1.0))
    return F.when(similarity >= floor, F.lit(0.0)).otherwise(off_topic)
