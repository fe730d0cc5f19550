"""Delivery of alerts to handlers on the executors, each alert once per handler.

The log has one row per (handler, signal_id) with what became of it. A batch sends only what the log
does not hold, so a batch that runs twice delivers once; an executor lost in the middle of a task
may call a handler again for the alerts of that task. Alerts of a session reach a handler in time
order, and the handlers of an alert are called in the order they were given. A handler that fails
``attempts`` times is recorded as ``dead`` and stops nobody; its alerts lie in the dead letters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

#: Called with the alert and the event it was raised for (None if unknown).
Handler = Callable[[Row, Row | None], None]

DELIVERED, DEAD, STOP = "delivered", "dead", "stop"
_LOG = "handler string, signal_id string, status string, attempts int, error string"


class StopOnSignal(Exception):
    """Raised by a handler: the alert counts as delivered, and the stream stops after its batch."""


def _outcome(handler: Handler, alert: Row, event: Row | None, attempts: int) -> tuple[str, int, str | None]:
    error = None
    for attempt in range(1, attempts + 1):
        try:
            handler(alert, event)
            return DELIVERED, attempt, None
        except StopOnSignal:
            return STOP, attempt, None
        except Exception as failure:  # noqa: BLE001 - one handler must not stop others
            error = f"{type(failure).__name__}: {failure}"
    return DEAD, attempts, error


@dataclass
class Outbox:
    """``handlers`` by name; a name is what the log knows a handler by."""

    folder: str
    handlers: dict[str, Handler] = field(default_factory=dict)
    attempts: int = 2

    def path(self, table: str, batch_id: int | None = None) -> str:
        base = f"{self.folder}/{table}"
        return base if batch_id is None else f"{base}/batch_id={batch_id}"

    def log(self, spark: SparkSession) -> DataFrame:
        """handler, signal_id, status, attempts, error, batch_id of everything sent so far."""
        if not getattr(self, "_ready", False):
            spark.createDataFrame([], _LOG).write.mode("append").parquet(self.path("deliveries", -1))
            self._ready = True
        return spark.read.schema(f"{_LOG}, batch_id int").parquet(self.path("deliveries"))

    def dead_letters(self, spark: SparkSession) -> DataFrame:
        """The alerts that a handler could not take, with handler and error."""
        return spark.read.parquet(self.path("dead_letters"))

    def pending(self, alerts: DataFrame, again: bool = False) -> DataFrame:
        """The alerts with the names of the handlers that have not had them (``_handlers``, in order);
        with ``again``, dead ones count as not had."""
        log = self.log(alerts.sparkSession)
        had = (log.filter(F.col("status") != DEAD) if again else log).groupBy("signal_id").agg(
            F.collect_set("handler").alias("_had")
        )
        names = F.array(*map(F.lit, self.handlers)).cast("array<string>")
        none = F.array().cast("array<string>")
        return (
            alerts.join(had, "signal_id", "left")
            .withColumn("_handlers", F.array_except(names, F.coalesce("_had", none)))
            .filter(F.size("_handlers") > 0)
            .drop("_had")
        )

    def deliver(self, alerts: DataFrame, batch_id: int, events: DataFrame | None = None, again: bool = False) -> None:
        """Send what is pending. ``alerts``: signal_id, session_id, ts and more; ``events``:
        session_id, turn_index and more, unique in both."""
        if not self.handlers:
            return
        spark = alerts.sparkSession
        open_ = self.pending(alerts, again)
        if events is not None:
            event = events.select("session_id", "turn_index", F.struct("*").alias("_event"))
            open_ = open_.join(event, ["session_id", "turn_index"], "left")
        handlers, attempts = dict(self.handlers), self.attempts

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for cells in batch.to_pylist():
                    names, event = cells.pop("_handlers"), cells.pop("_event", None)
                    alert, event = Row(**cells), Row(**event) if event else None
                    for name in names:
                        out.append((name, alert.signal_id, *_outcome(handlers[name], alert, event, attempts)))
                columns = list(zip(*out, strict=True)) or [()] * 5
                kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    ["handler", "signal_id", "status", "attempts", "error"],
                )

        ordered = open_.repartition("session_id").sortWithinPartitions("session_id", "ts", "signal_id")
        ordered.mapInArrow(send, _LOG).write.mode("append").parquet(self.path("deliveries", batch_id))
        log = self.log(spark)
        fine = log.filter(F.col("status") != DEAD).select("handler", "signal_id")
        mine = log.filter(F.col("batch_id") == batch_id)
        dead = mine.filter(F.col("status") == DEAD).join(fine, ["handler", "signal_id"], "left_anti")
        alerts.join(dead.select("signal_id", "handler", "error").distinct(), "signal_id").write.mode("overwrite").parquet(
            self.path("dead_letters", batch_id)
        )

    def stops(self, spark: SparkSession, batch_id: int) -> int:
        """How many alerts of the batch asked the stream to stop."""
        return self.log(spark).filter((F.col("batch_id") == batch_id) & (F.col("status") == STOP)).count()
