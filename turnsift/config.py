"""Thresholds and sizes shared by every job."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

CONF_PREFIX = "spark.turnsift."


@dataclass(frozen=True)
class ScanConfig:
    """One immutable bag of settings; pass it to the operators that need it."""

    threshold: float = 0.25
    compromised_at: float = 0.75
    false_alarm_bar: float = 0.70
    similarity: float = 0.70
    window_turns: int = 3
    fingerprinting: bool = True
    use_model: bool = True
    baseline_turns: int = 5
    pivot_score: float = 0.5
    sensitive_factor: float = 1.5
    drift_floor: float = 0.20
    clamp_drift: bool = False
    max_scan_chars: int = 500_000

    @classmethod
    def from_session(cls, spark) -> "ScanConfig":
        """Read ``spark.turnsift.<field>`` settings; a bad value keeps the default."""
        found = {}
        for field in fields(cls):
            raw = spark.conf.get(CONF_PREFIX + field.name, None)
            if raw is None:
                continue
            try:
                found[field.name] = _parse(raw, type(field.default))
            except ValueError:
                continue
        config = replace(cls(), **found)
        return replace(config, window_turns=max(0, config.window_turns))


def _parse(raw: str, kind: type):
    if kind is bool:
        return raw.strip().lower() in ("1", "true", "yes")
    return kind(raw)
