"""Turns of sessions as a stateful processor with typed state, expiry and a start from tables.

The state of a session is a value (next turn, last hash, newest time) and a list (the external texts
of the last turns). Both expire ``keep_ms`` after the last message, in processing time: an
event-time operator would not be shown late messages at all, and a late message still has to be
scanned. ``heads_of`` makes the same state from stored events, and a stream that starts with it
continues their numbers, hashes and windows. A session that returns after its state is gone starts
like a new one unless the stream is started again with heads.

Transform-with-state keeps its state in RocksDB; ``state_in_rocksdb`` sets that for queries started
inside. In processing time Spark would also run batches without data for ever, so they are off.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from turnsift.config import ScanConfig
from turnsift.functions import text as X
from turnsift.operators.detect import with_own_sources
from turnsift.operators.durable import written

KEEP_MS = 90 * 24 * 3600 * 1000
LATE_SECONDS = 3600

_HEAD = "next_turn int, last_hash string, newest long"
_TEXT = "text string, sources array<string>"
_OUT = (
    "session_id string, event_id string, turn_index int, prev_hash string, event_hash string, "
    "own_text string, sources array<string>, window_texts array<string>, "
    "window_sources array<string>, window_size int, late boolean"
)
_COLUMNS = [part.split()[0] for part in _OUT.split(", ")]
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in _SETTINGS}
    for name, value in _SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class TurnProcessor(StatefulProcessor):
    """Numbers, chains and windows the messages of one session."""

    def __init__(self, window_turns: int, late_seconds: int, keep_ms: int):
        self.size, self.late_micros, self.keep_ms = max(window_turns, 1), late_seconds * 1_000_000, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", _HEAD, self.keep_ms)
        self.texts = handle.getListState("texts", _TEXT, self.keep_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState.itertuples(index=False):
            newest = None if pd.isna(row.newest) else int(row.newest)
            self.head.update((int(row.next_turn), row.last_hash, newest))
            ring = [(text["text"], list(text["sources"])) for text in row.texts][-self.size :]
            if ring:
                self.texts.put(ring)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turn, last, newest = self.head.get() if self.head.exists() else (0, "", None)
        ring = [(text, list(sources)) for text, sources in self.texts.get()] if self.texts.exists() else []
        batch = pd.concat(list(rows)).sort_values(["micros", "event_id"], kind="stable")
        out = []
        for row in batch.itertuples(index=False):
            sources = [] if row.sources is None else list(row.sources)
            text = row.own_text if isinstance(row.own_text, str) else None
            if newest is not None and row.micros < newest - self.late_micros:
                out.append((key[0], row.event_id, None, None, None, text, sources, [], [], 0, True))
                continue
            ring = [*ring, (text, sources)][-self.size :]
            previous, last = last, hashlib.sha256((last + row.digest).encode()).hexdigest()
            out.append((
                key[0], row.event_id, turn, previous, last, text, sources,
                [t for t, _ in ring if t is not None], [s for _, found in ring for s in found], len(ring), False,
            ))
            turn += 1
            newest = row.micros if newest is None else max(newest, row.micros)
        self.head.update((turn, last, newest))
        if ring:
            self.texts.put(ring)
        yield pd.DataFrame(out, columns=_COLUMNS).astype({"turn_index": "Int32"})

    def close(self) -> None:
        pass


def _slim(messages: DataFrame) -> DataFrame:
    external = (F.col("content") != "") & X.is_external(F.col("role"), F.col("content"))
    return with_own_sources(messages).select(
        "session_id", "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"),
        F.when(external, F.col("content")).alias("own_text"),
        "sources", "digest",
    )


def heads_of(stored: DataFrame, chain: DataFrame, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """session_id, next_turn, last_hash, newest, texts of stored sessions. ``stored``: messages as for
    ``continued_turns`` plus turn_index; ``chain``: session_id, turn_index, event_hash."""
    slim = _slim(stored).join(stored.select("event_id", "turn_index"), "event_id")
    last_first = Window.partitionBy("session_id").orderBy(F.desc("turn_index"))
    recent = (
        slim.withColumn("_nth", F.row_number().over(last_first))
        .filter(F.col("_nth") <= max(cfg.window_turns, 1))
        .groupBy("session_id")
        .agg(F.transform(
            F.sort_array(F.collect_list(F.struct("turn_index", F.struct(F.col("own_text").alias("text"), "sources").alias("t")))),
            lambda x: x["t"],
        ).alias("texts"))
    )
    newest = slim.groupBy("session_id").agg(F.max("micros").alias("newest"))
    last = chain.groupBy("session_id").agg(
        (F.max("turn_index") + 1).cast("int").alias("next_turn"), F.max_by("event_hash", "turn_index").alias("last_hash")
    )
    return last.join(newest, "session_id").join(recent, "session_id")


def continued_turns(
    messages: DataFrame,
    heads: DataFrame | None = None,
    cfg: ScanConfig = ScanConfig(),
    late_seconds: int = LATE_SECONDS,
    keep_ms: int = KEEP_MS,
) -> DataFrame:
    """Number, chain and window the turns of a stream; the columns are those of ``session_turns``.

    messages: session_id, event_id, ts, role, content, digest. ``heads`` is the state to start with.
    A message older than its session's newest by more than ``late_seconds`` comes out with ``late``
    set and neither number nor hash.
    """
    initial = None if heads is None else written(heads, "turn-heads").groupBy("session_id")
    return _slim(messages).groupBy("session_id").transformWithStateInPandas(
        TurnProcessor(cfg.window_turns, late_seconds, keep_ms), _OUT, "Append", "ProcessingTime", initial
    )
