"""Keeping signals of known false alarms out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnsift.config import ScanConfig
from turnsift.functions.grams import gram_embedding
from turnsift.operators.durable import written
from turnsift.operators.lsh import LSH_ABOVE, covered


def _with_approval(
    df: DataFrame, text: str, in_band: Column, approved: DataFrame, cfg: ScanConfig, lsh_above: int
) -> DataFrame:
    """Add _approved: the text of an in-band row matches an approved fingerprint.

    Only distinct texts inside the band are embedded and compared. ``approved`` has
    fingerprint_id and vector. ``df`` is read twice.
    """
    inside = F.coalesce(in_band, F.lit(False)) & F.col(text).isNotNull()
    texts = written(
        df.filter(inside).select(F.col(text).alias("text")).distinct()
        .select(F.sha2("text", 256).alias("id"), gram_embedding("text").alias("vector")),
        "band-texts",
    )
    refs = approved.select(F.col("fingerprint_id").alias("ref"), F.col("fingerprint_id").alias("rank"), "vector")
    alike = written(
        covered(texts, refs, cfg.similarity, lsh_above).select(F.col("id").alias("_key")).withColumn("_approved", F.lit(True)),
        "band-approved",
    )
    # Rows outside the band get keys that match nothing but spread over the partitions.
    key = F.when(inside, F.sha2(text, 256)).otherwise(F.concat(F.lit("-"), F.xxhash64(text).cast("string")))
    return (
        df.withColumn("_key", key).join(alike, "_key", "left")
        .withColumn("_approved", F.coalesce("_approved", F.lit(False))).drop("_key")
    )


def drop_false_alarms(
    flagged: DataFrame,
    text: str,
    approved: DataFrame,
    cfg: ScanConfig = ScanConfig(),
    lsh_above: int = LSH_ABOVE,
) -> DataFrame:
    """Drop rows below the high-confidence bar whose text matches an approved fingerprint."""
    in_band = F.col("score") < cfg.false_alarm_bar
    checked = _with_approval(flagged, text, in_band, approved, cfg, lsh_above)
    return checked.filter(~F.col("_approved")).drop("_approved")


def unflag_false_alarms(
    scanned: DataFrame,
    text: str,
    approved: DataFrame,
    cfg: ScanConfig = ScanConfig(),
    lsh_above: int = LSH_ABOVE,
) -> DataFrame:
    """The same for rows that stay in the table: only their ``flagged`` is taken back."""
    in_band = F.col("flagged") & (F.col("score") < cfg.false_alarm_bar)
    checked = _with_approval(scanned, text, in_band, approved, cfg, lsh_above)
    return checked.withColumn("flagged", F.col("flagged") & ~F.col("_approved")).drop("_approved")
