"""Positions of rows inside groups of any size.

Rows are dealt in ranges of (group, order, row number), so a group that holds a third of all rows
lies in many partitions, and equal rows do too. A row's position is its place in its partition
plus the rows its group has in earlier partitions; of those counts there is one a group and
partition, and only they are joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from turnsift.operators.durable import written


def ranked(rows: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with ``rank`` (0-based place in the group, by ``order``, nulls first; equal rows in
    any order) and ``group_rows``. ``rows`` should be a written table, ``group`` never null."""
    keys = [F.col(c).asc_nulls_first() for c in (group, *order, "_row")]
    placed = written(
        rows.withColumn("_row", F.monotonically_increasing_id())
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .drop("_row")
        .withColumn("_at", F.monotonically_increasing_id()),
        name,
    )
    part = F.shiftright("_at", 33).alias("_part")
    parts = Window.partitionBy(group).orderBy("_part")
    bases = (
        placed.groupBy(group, part)
        .agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_base",
            F.coalesce(F.sum("_n").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            - F.col("_first"),
        )
        .withColumn("group_rows", F.sum("_n").over(Window.partitionBy(group)))
        .select(group, "_part", "_base", "group_rows")
    )
    return (
        placed.withColumn("_part", F.shiftright("_at", 33))
        .join(bases, [group, "_part"])
        .withColumn("rank", F.col("_at") + F.col("_base"))
        .drop("_at", "_part", "_base")
    )
