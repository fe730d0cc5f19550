"""Where streamed signals go: tables first, then campaigns, then the registered callables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from turnsift.config import ScanConfig
from turnsift.operators import fingerprints as fp
from turnsift.operators.durable import written
from turnsift.streaming.outbox import Handler, Outbox, StopOnSignal

ALERT_COLUMNS = (
    "session_id", "turn_index", "score", "matched_heuristics", "source", "evidence_snippet",
)

_everywhere: list[Handler] = []


def register_everywhere(handler: Handler) -> None:
    """Call the handler for the alerts of every sink in this process; once per handler."""
    if handler not in _everywhere:
        _everywhere.append(handler)


def unregister_everywhere(handler: Handler) -> None:
    if handler in _everywhere:
        _everywhere.remove(handler)


def stop_on_signal(alert: Row, event: Row | None = None) -> None:
    raise StopOnSignal(f"signal in session {alert['session_id']}")


@dataclass
class SignalSink:
    """``foreachBatch`` target. Every table is written per batch id with overwrite, so a
    batch that runs twice leaves the same result.

    Fingerprints are kept as deltas: a batch writes only the fingerprints it touched, and every
    ``compact_every`` batches the deltas are merged into a new full table. A batch reads the last
    full table and the deltas since, all of earlier batches, so a repeated batch sees what it saw.

    ``handlers`` are called on the executors with the alert and its event (from ``events``: session_id,
    turn_index and more) through an ``Outbox``: once per alert even if the batch runs twice, what
    fails goes to the dead letters. ``StopOnSignal`` from one of them stops the stream after the
    batch. ``partition_handlers`` get an iterator of alerts; a batch that runs twice calls them twice.
    """

    folder: str
    cfg: ScanConfig = field(default_factory=ScanConfig)
    handlers: list[Handler] = field(default_factory=list)
    partition_handlers: list[Callable[[Iterator[Row]], None]] = field(default_factory=list)
    compact_every: int = 16
    events: DataFrame | None = None

    def on_signal(self, handler: Handler) -> None:
        self.handlers.append(handler)

    def on_partition(self, handler: Callable[[Iterator[Row]], None]) -> None:
        self.partition_handlers.append(handler)

    def path(self, table: str, batch_id: int | None = None) -> str:
        base = f"{self.folder}/{table}"
        return base if batch_id is None else f"{base}/batch_id={batch_id}"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """``batch``: signal columns plus signal_id and ts."""
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(self.path("signals", batch_id))
        signals = spark.read.parquet(self.path("signals", batch_id))
        enriched = signals.withColumn(
            "campaign_match",
            F.lit(None).cast("struct<fingerprint_id:string,hit_count:bigint,campaign_name:string>"),
        )
        if self.cfg.fingerprinting:
            enriched = self._campaigns(signals, batch_id)
        enriched.write.mode("overwrite").parquet(self.path("alerts", batch_id))
        self._fire(spark.read.parquet(self.path("alerts", batch_id)), batch_id)

    def outbox(self) -> Outbox:
        """The delivery log of all handlers, those of this process last; a handler is known by its
        place and name."""
        found = [*self.handlers, *_everywhere]
        names = {f"{i}:{getattr(h, '__qualname__', type(h).__name__)}": h for i, h in enumerate(found)}
        return Outbox(self.path("outbox"), names)

    def fingerprints(self, spark: SparkSession, batches: int) -> DataFrame | None:
        """The fingerprints after the first ``batches`` batches."""
        full = batches // self.compact_every * self.compact_every - 1
        tables = []
        if full >= 0:
            tables.append(spark.read.parquet(self.path("fingerprints", full)).withColumn("_batch", F.lit(-1)))
        for number in range(full + 1, batches):
            delta = spark.read.parquet(self.path("fingerprint_deltas", number))
            tables.append(delta.withColumn("_batch", F.lit(number)))
        if not tables:
            return None
        return fp.merge_deltas(reduce(DataFrame.unionByName, tables), "_batch")

    def _campaigns(self, signals: DataFrame, batch_id: int) -> DataFrame:
        """Assign fingerprints and write what this batch adds to their table."""
        spark = signals.sparkSession
        stored = self.fingerprints(spark, batch_id)
        if stored is not None:
            stored = written(stored, "stored-fingerprints")
        assigned = fp.assign_fingerprints(signals, stored, self.cfg)
        assigned.write.mode("overwrite").parquet(self.path("assigned", batch_id))
        assigned = spark.read.parquet(self.path("assigned", batch_id))
        links = fp.session_links(assigned)
        links.write.mode("overwrite").parquet(self.path("links", batch_id))
        delta = fp.new_fingerprints(assigned)
        delta.write.mode("overwrite").parquet(self.path("fingerprint_deltas", batch_id))
        if (batch_id + 1) % self.compact_every == 0:
            tables = [spark.read.parquet(self.path("fingerprint_deltas", batch_id)).withColumn("_batch", F.lit(1))]
            if stored is not None:
                tables.append(stored.withColumn("_batch", F.lit(0)))
            merged = fp.merge_deltas(reduce(DataFrame.unionByName, tables), "_batch")
            merged.write.mode("overwrite").parquet(self.path("fingerprints", batch_id))
        return fp.with_campaign_match(assigned, stored)

    def _fire(self, alerts: DataFrame, batch_id: int) -> None:
        for run in self.partition_handlers:
            alerts.foreachPartition(run)
        outbox = self.outbox()
        if not outbox.handlers:
            return
        outbox.deliver(alerts, batch_id, self.events)
        stops = outbox.stops(alerts.sparkSession, batch_id)
        if stops:
            raise StopOnSignal(f"{stops} alerts of batch {batch_id} stop the stream")


def alert_feed(alerts: DataFrame) -> DataFrame:
    """The six columns a live view shows."""
    return alerts.select(*ALERT_COLUMNS)
