"""Tamper-evident hash chains per session.

event_hash = sha256(prev_hash || content_digest), content_digest = sha256(canonical JSON).
Digests and verification are JVM-side and parallel in every respect. Building a chain is
sequential by definition, so only the 64-character digests are sorted and streamed through
a task, one row at a time, and a long session is spread over batches by ``heads``.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from turnsift.operators.ordered import CHUNK_ROWS, chunk_of, with_previous


def canonical_json(columns: Sequence[str]) -> Column:
    """Compact JSON of the columns in name order, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def content_digest(columns: Sequence[str]) -> Column:
    return F.sha2(canonical_json(columns), 256)


def build_chain(events: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """prev_hash and event_hash of new events (session_id, turn_index, event_id, digest).

    ``heads`` (session_id, last_hash) continues stored chains. ``turn_index`` is unique in
    a session.
    """
    columns = ["session_id", "turn_index", "event_id", "digest"]
    rows = events.select(*columns)
    if heads is None:
        rows = rows.withColumn("last_hash", F.lit(""))
    else:
        rows = rows.join(heads.select("session_id", "last_hash"), "session_id", "left")
        rows = rows.withColumn("last_hash", F.coalesce("last_hash", F.lit("")))
    kinds = dict(rows.dtypes)
    schema = (
        f"session_id {kinds['session_id']}, turn_index {kinds['turn_index']}, "
        f"event_id {kinds['event_id']}, prev_hash string, event_hash string"
    )

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, last = None, ""
        for batch in batches:
            before, after = [], []
            for sid, digest, head in zip(batch["session_id"], batch["digest"], batch["last_hash"]):
                if sid != session:
                    session, last = sid, head
                before.append(last)
                last = hashlib.sha256((last + digest).encode()).hexdigest()
                after.append(last)
            yield batch[["session_id", "turn_index", "event_id"]].assign(
                prev_hash=before, event_hash=after
            )

    return (
        rows.repartition("session_id")
        .sortWithinPartitions("session_id", "turn_index")
        .mapInPandas(link, schema)
    )


def with_link_check(
    events: DataFrame, order: Sequence[str] = ("turn_index",), chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Add link_ok: prev_hash is the event_hash of the event before, '' for the first."""
    linked = with_previous(
        events, ["session_id"], order, chunk_of(F.col("turn_index"), chunk_rows), ["event_hash"]
    )
    expected = F.coalesce(F.col("previous.event_hash"), F.lit(""))
    return linked.withColumn("link_ok", F.col("prev_hash").eqNullSafe(expected)).drop("previous")


def with_hash_check(events: DataFrame, digest: Column) -> DataFrame:
    """Add hash_ok: the hash recomputed from the content equals the stored one."""
    recomputed = F.sha2(F.concat(F.col("prev_hash"), digest), 256)
    return events.withColumn("hash_ok", F.col("event_hash").eqNullSafe(recomputed))


def chain_validity(checked: DataFrame) -> DataFrame:
    return checked.groupBy("session_id").agg(
        F.bool_and(F.col("link_ok") & F.col("hash_ok")).alias("chain_valid"),
        F.count(F.lit(1)).alias("total_turns"),
    )


def chain_ledger(checked: DataFrame) -> DataFrame:
    """session_id, last_turn, last_hash, chain_valid, total_turns after a full verification; ``checked``
    has link_ok and hash_ok."""
    return checked.groupBy("session_id").agg(
        F.max("turn_index").alias("last_turn"),
        F.max_by("event_hash", "turn_index").alias("last_hash"),
        F.bool_and(F.col("link_ok") & F.col("hash_ok")).alias("chain_valid"),
        F.count(F.lit(1)).alias("total_turns"),
    )


def extended_ledger(
    ledger: DataFrame, events: DataFrame, digest: Column, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """The ledger after verifying only events behind its last turns.

    ``events``: session_id, turn_index, prev_hash, event_hash and what ``digest`` needs. Events up to a
    session's last verified turn are left out before anything is hashed; the first one behind it
    has to link to the ledger's hash. A chain found broken stays broken. What happened to verified
    events since is not seen: that takes a full verification, or a ledger kept apart.
    """
    known = ledger.select("session_id", "last_turn", "last_hash")
    fresh = (
        events.join(known, "session_id", "left")
        .filter(F.col("last_turn").isNull() | (F.col("turn_index") > F.col("last_turn")))
        .drop("last_turn")
    )
    linked = with_previous(fresh, ["session_id"], ["turn_index"], chunk_of(F.col("turn_index"), chunk_rows), ["event_hash"])
    expected = F.coalesce(F.col("previous.event_hash"), F.col("last_hash"), F.lit(""))
    checked = with_hash_check(
        linked.withColumn("link_ok", F.col("prev_hash").eqNullSafe(expected)).drop("previous"), digest
    )
    new = chain_ledger(checked).withColumn("_step", F.lit(1))
    return (
        ledger.withColumn("_step", F.lit(0)).unionByName(new)
        .groupBy("session_id")
        .agg(
            F.max("last_turn").alias("last_turn"),
            F.max_by("last_hash", "_step").alias("last_hash"),
            F.bool_and("chain_valid").alias("chain_valid"),
            F.sum("total_turns").alias("total_turns"),
        )
    )


@F.pandas_udf(StringType())
def imported_event_hash(payload: pd.Series, prev_hash: pd.Series) -> pd.Series:
    """Hash of an imported trace event: prev_hash + sorted-key JSON without event_hash."""

    def one(text: str | None, prev: str | None) -> str | None:
        if text is None or prev is None:
            return None
        body = json.loads(text)
        body.pop("event_hash", None)
        body["prev_hash"] = prev
        canonical = json.dumps(body, sort_keys=True, ensure_ascii=False)
        return hashlib.sha256((prev + canonical).encode()).hexdigest()

    return pd.Series([one(text, prev) for text, prev in zip(payload, prev_hash)], dtype=object)


def with_imported_hash_check(events: DataFrame) -> DataFrame:
    """hash_ok for imported traces that carry their JSON in ``payload``."""
    expected = imported_event_hash(F.col("payload"), F.col("prev_hash"))
    return events.withColumn("hash_ok", F.col("event_hash").eqNullSafe(expected))
