"""All registered queries and the SQL they are compared with."""

from __future__ import annotations

from turnsift.plans import (
    behavior_reports,
    classified,
    detection,
    evaluation,
    fingerprinting,
    ingest,
    session_tables,
    settings,
    streams,
)

_MODULES = (
    detection,
    classified,
    session_tables,
    behavior_reports,
    fingerprinting,
    evaluation,
    ingest,
    settings,
    streams,
)


def registered() -> dict:
    found: dict = {}
    for module in _MODULES:
        for name, entry in module.QUERIES.items():
            if name in found:
                raise ValueError(f"query {name} registered twice")
            found[name] = entry
    return found
