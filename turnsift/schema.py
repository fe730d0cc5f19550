"""Explicit schemas of every table; JSON and Parquet reads never infer one."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()
_I = T.IntegerType()
_D = T.DoubleType()
_TS = T.TimestampType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


MESSAGE = _struct(role=_S, content=_S, tool_call_id=_S, tool_calls=_S)
TOOL_CALL = _struct(id=_S, name=_S, arguments=_S, result=_S)

MESSAGES = _struct(
    session_id=_S, turn_index=_I, msg_index=_I, role=_S, content=_S, ts=_TS
)

TRACE_EVENTS = _struct(
    event_id=_S,
    session_id=_S,
    turn_index=_I,
    timestamp=_TS,
    messages_in=T.ArrayType(MESSAGE),
    message_out=MESSAGE,
    tool_calls=T.ArrayType(TOOL_CALL),
    model=_S,
    external_sources=T.ArrayType(_S),
    prev_hash=_S,
    event_hash=_S,
)

CAMPAIGN_MATCH = _struct(fingerprint_id=_S, hit_count=T.LongType(), campaign_name=_S)

SIGNALS = _struct(
    session_id=_S,
    turn_index=_I,
    msg_index=_I,
    stage=_S,
    score=_D,
    matched_heuristics=T.ArrayType(_S),
    source=_S,
    evidence_snippet=_S,
    campaign_match=CAMPAIGN_MATCH,
)

# Sessions of a fingerprint live in a link table, not in an array: one campaign
# can reach a large share of all sessions.
FINGERPRINTS = _struct(
    fingerprint_id=_S,
    first_seen=_TS,
    last_seen=_TS,
    hit_count=T.LongType(),
    representative_snippet=_S,
    vector=T.ArrayType(_D),
    campaign_name=_S,
    approved=T.BooleanType(),
)
FINGERPRINT_SESSIONS = _struct(fingerprint_id=_S, session_id=_S, first_seen=_TS)

ROLES = ("system", "user", "assistant", "tool")
