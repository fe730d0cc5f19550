"""Shards of near equal bytes by fixed virtual slots.

Every record hashes into one of ``SLOTS`` virtual slots; the number never changes. Rows and bytes
are summed per slot, and a map says which shard holds a slot. The map is versioned: version 1
deals the slots in turn; rebalancing reads the sums and writes a new version that holds only the
edited entries, and the latest entry of a slot counts. Growing by a shard is another edit, which
only moves slots into the new shard.

Identical records hash alike, so a record that is a third of all rows makes one slot too heavy for
any shard. A slot heavier than ``1 / LANES`` of a mean shard is therefore dealt in lanes of equal
row counts, by the rank of its rows modulo the number of lanes; map entries are (slot, lane).

Contract. Size is the UTF-8 bytes of the text (null text: none, crc32 of nothing is 0) plus 16. All
columns may be null, equal rows and ids are rows like any other, and since lanes and places go by
rank, a rerun gives the same rows. Copies of a text need not share a shard, or they could not be
spread. ``slot`` is the row's place in its shard, 0 to rows - 1; ``virtual_slot`` and ``lane`` tell
where it comes from. The law is ``bytes``: shards differ by less than the lightest
move or exchange between the heaviest and the lightest could mend, and one very long text is never
cut. An empty table gives no rows. Only doc_id and text are read.

Scale. Texts are hashed and measured where they are read and never move. Ranks come from ranges
(``ranks.ranked``), so a hot slot is many tasks. What reaches the driver is the map: ``SLOTS`` +
``LANES * shards`` entries at most, whatever the input. It is also what is broadcast.
"""

from __future__ import annotations

from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from turnsift.llm.ranks import ranked
from turnsift.operators.durable import ensure_checkpoint_dir, written

SLOTS = 4096
SHARDS = 40
LANES = 32
ROW_BYTES = 16
SEED = 40_961
_ENTRY = ["virtual_slot", "lanes", "lane"]
_FIELDS = [*_ENTRY, "shard", "rows", "bytes"]
_MAP = "virtual_slot int, lanes int, lane int, shard int, rows long, bytes long"


def slotted(docs: DataFrame, slots: int = SLOTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, rank in the slot; ``keep`` names columns to carry."""
    text = F.coalesce("text", F.lit(""))
    measured = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", text, F.lit(SEED)), F.lit(slots)).cast("int").alias("virtual_slot"),
        *(F.col(c).alias(f"_kept_{c}") for c in keep),
    )
    placed = ranked(
        written(measured, "shard-rows"), "virtual_slot", ["doc_id", "text_crc32", "size"], "shard-ranges"
    )
    return placed.drop("group_rows")


def with_lanes(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Add lanes of the row's slot, and its lane."""
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.sum("size").alias("total"))
    limit = F.greatest(F.lit(1), F.floor(F.col("total") / (shards * LANES)))
    lanes = sums.join(F.broadcast(total)).select(
        "virtual_slot", F.ceil(F.col("bytes") / limit).cast("int").alias("lanes")
    )
    return rows.join(F.broadcast(lanes), "virtual_slot").withColumn("lane", (F.col("rank") % F.col("lanes")).cast("int"))


def slot_sums(rows: DataFrame) -> pd.DataFrame:
    """Rows and bytes per map entry, on the driver: bounded by the number of slots and lanes."""
    sums = rows.groupBy(*_ENTRY).agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
    return sums.toPandas().sort_values(_ENTRY, ignore_index=True)


def first_map(sums: pd.DataFrame, shards: int) -> pd.DataFrame:
    return sums.assign(shard=(np.arange(len(sums)) % shards).astype("int32"))


def rebalanced(held: pd.DataFrame, shards: int) -> pd.DataFrame:
    """The map after moving as few entries as evens out the bytes: what is over the mean leaves its
    shard, heaviest first, and goes to the lightest one; then the heaviest and the lightest shard
    move or exchange an entry as long as that brings them closer."""
    weight, shard = held["bytes"].to_numpy(np.int64), held["shard"].to_numpy(np.int64).copy()
    if not len(held):
        return held
    loads = np.bincount(shard, weight, shards).astype(np.int64)
    mean = -(-int(weight.sum()) // shards)
    loose = []
    for i in np.argsort(-weight, kind="stable"):
        if loads[shard[i]] - weight[i] >= mean:
            loads[shard[i]] -= weight[i]
            loose.append(i)
    for i in loose:
        shard[i] = int(np.argmin(loads))
        loads[shard[i]] += weight[i]
    while True:
        full, free = int(np.argmax(loads)), int(np.argmin(loads))
        gap = int(loads[full] - loads[free])
        mine, theirs = np.flatnonzero(shard == full), np.flatnonzero(shard == free)
        gain = weight[mine][:, None] - np.concatenate(([0], weight[theirs]))[None, :]
        off = np.where((gain > 0) & (gain < gap), np.abs(2 * gain - gap), gap)
        i, j = np.unravel_index(int(np.argmin(off)), off.shape)
        if off[i, j] >= gap:
            return held.assign(shard=shard.astype("int32"))
        shard[mine[i]] = free
        if j:
            shard[theirs[j - 1]] = full
        loads[full] -= gain[i, j]
        loads[free] += gain[i, j]


def grown(held: pd.DataFrame, shards: int) -> pd.DataFrame:
    """The map with one more shard (number ``shards``), which takes its share from the fullest; no
    other entry moves."""
    weight, shard = held["bytes"].to_numpy(np.int64), held["shard"].to_numpy(np.int64).copy()
    loads = np.bincount(shard, weight, shards + 1).astype(np.int64)
    mean = int(weight.sum()) // (shards + 1)
    while len(held):
        full = int(np.argmax(loads[:shards]))
        room = mean - loads[shards]
        mine = np.flatnonzero((shard == full) & (weight <= room) & (weight > 0))
        if not len(mine) or loads[full] <= mean:
            break
        best = mine[np.argmin(np.abs(weight[mine] - min(room, loads[full] - mean)))]
        shard[best] = shards
        loads[full] -= weight[best]
        loads[shards] += weight[best]
    return held.assign(shard=shard.astype("int32"))


def store_edits(spark: SparkSession, path: str, new: pd.DataFrame, old: pd.DataFrame | None = None) -> int:
    """Append the entries in which ``new`` differs from ``old`` as the next version; the number of
    the version that now holds, which is the old one where nothing differs."""
    version = 1
    if old is not None:
        version = (spark.read.parquet(path).agg(F.max("version")).first()[0] or 0) + 1
        changed = new["shard"].to_numpy() != old["shard"].to_numpy()
        new = new[changed]
    if old is not None and not len(new):
        return version - 1
    table = spark.createDataFrame(new[_FIELDS], _MAP) if len(new) else spark.createDataFrame([], _MAP)
    table.withColumn("version", F.lit(version)).coalesce(1).write.mode("append").parquet(path)
    return version


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The entries as of a version (default: the latest), with the version that last edited each."""
    edits = spark.read.parquet(path)
    if version is not None:
        edits = edits.filter(F.col("version") <= version)
    last = F.max_by(F.struct("shard", "rows", "bytes", "version"), "version")
    return edits.groupBy(*_ENTRY).agg(last.alias("_last")).select(*_ENTRY, "_last.*")


def placed(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Add shard and place in the shard to ``with_lanes`` rows."""
    entries = slot_map.toPandas().sort_values(["shard", *_ENTRY], ignore_index=True)
    entries["start"] = entries.groupby("shard")["rows"].cumsum() - entries["rows"]
    schema = "virtual_slot int, lanes int, lane int, shard int, start long, version int"
    columns = [*_ENTRY, "shard", "start", "version"]
    spark = rows.sparkSession
    table = spark.createDataFrame(entries[columns], schema) if len(entries) else spark.createDataFrame([], schema)
    return (
        rows.join(F.broadcast(table), _ENTRY)
        .withColumn("slot", F.col("start") + F.floor(F.col("rank") / F.col("lanes")))
        .drop("start", "rank")
    )


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, virtual_slot, lane, version. The map goes to
    ``map_path`` (default: beside the working tables), as version 1 and its rebalanced version 2."""
    spark = docs.sparkSession
    rows = with_lanes(slotted(docs, slots), shards)
    sums = slot_sums(rows)
    if map_path is None:
        map_path = f"{ensure_checkpoint_dir(spark)}/slot-map-{uuid4().hex}"
    dealt = first_map(sums, shards)
    store_edits(spark, map_path, dealt)
    store_edits(spark, map_path, rebalanced(dealt, shards), dealt)
    return placed(rows, load_map(spark, map_path))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "lane", "version",
    )
