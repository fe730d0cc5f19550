"""All outputs of a stream of turns in one commit per batch.

A batch leaves signals, late turns and the chain, each in a folder of its batch id that is written
over when the batch runs again, and at last its row in the commits. Readers take committed batches
only, so they see all outputs of a batch or none, however often and however far it ran.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnsift.config import ScanConfig
from turnsift.streaming.jobs import late_turns, turn_signals

CHAIN_COLUMNS = ("session_id", "event_id", "turn_index", "prev_hash", "event_hash")


@dataclass
class TurnSink:
    """``foreachBatch`` target for the turns of ``session_turns`` or ``continued_turns``."""

    folder: str
    cfg: ScanConfig = field(default_factory=ScanConfig)

    def path(self, table: str, batch_id: int | None = None) -> str:
        base = f"{self.folder}/{table}"
        return base if batch_id is None else f"{base}/batch_id={batch_id}"

    def _put(self, rows: DataFrame, table: str, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(self.path(table, batch_id))

    def __call__(self, turns: DataFrame, batch_id: int) -> None:
        spark = turns.sparkSession
        self._put(turns, "turns", batch_id)  # what the state gave, once, for all outputs
        given = spark.read.schema(turns.schema).parquet(self.path("turns", batch_id))
        self._put(turn_signals(given, self.cfg), "signals", batch_id)
        self._put(late_turns(given), "late", batch_id)
        self._put(given.filter("NOT late").select(*CHAIN_COLUMNS), "chain", batch_id)
        counts = given.agg(F.count(F.lit(1)).alias("turns"), F.count_if("late").alias("late"))
        self._put(counts.coalesce(1), "commits", batch_id)

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        """Rows of the committed batches, with batch_id."""
        done = spark.read.parquet(self.path("commits")).select("batch_id")
        rows = spark.read.parquet(self.path(table))
        return rows.join(done, "batch_id", "left_semi")
