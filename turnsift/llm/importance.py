"""Quality selection by importance resampling.

Words and word pairs are hashed to ``BUCKETS`` buckets. Two bag-of-n-gram models, one of target
documents (labelled good and not toxic) and one of all raw documents, give every bucket a log
ratio of smoothed probabilities. A document's log importance is the sum of the log ratios of all its
n-grams, the log of the ratio of the two generative models, whatever its length; it is divided by
``TEMPERATURE`` (1: the plain ratio).
Sampling without replacement in proportion to importance is a top-k: every document gets
importance plus Gumbel noise, and the k largest keys are selected. The noise is a hash of the
doc_id, so a rerun selects the same rows.

The raw model counts all documents. The target model counts a bounded sample: the ``TARGET_ROWS``
labelled documents with the smallest hashes. The k-th largest key is found exactly by counting
keys per interval and narrowing to the interval that holds it; only interval counts leave Spark.

Contract: one row per input row with ``selected``. k is the ceiling of the share times the rows;
rows that tie with the k-th are all selected (repeated rows tie). A text without words, or null,
has importance 0. Rows with a null doc_id share one noise value. Null labels are no labels; a
document labelled more than once is a target if one row says so. Without target documents every
ratio is 0. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from turnsift.llm.texts import bounded_batches, mix, text_slices, word_hashes
from turnsift.operators.durable import written

BUCKETS = 1 << 16
SMOOTHING = 1.0
TEMPERATURE = 1.0
KEEP_SHARE = 0.85
TARGET_ROWS = 20_000
SEED = 77

_PAIR = np.uint64(0x9E3779B97F4A7C15)
_BLOCKS = 64
_INTERVALS = 4096
#: Keys are compared as whole numbers of this unit.
_UNIT = 1e-9


def grams(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every word and every pair of neighbouring words."""
    words, rows = word_hashes(texts)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    pairs = mix(words[:-1] * _PAIR + words[1:])
    inner = row[:-1] == row[1:]
    mask = np.uint64(buckets - 1)
    bucket = np.concatenate((words & mask, pairs[inner] & mask)).astype(np.int64)
    return bucket, np.concatenate((row, row[:-1][inner]))


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    if not target.sum():
        return np.zeros(len(raw))

    def share(counts: np.ndarray) -> np.ndarray:
        return np.log((counts + SMOOTHING) / (counts.sum() + SMOOTHING * len(counts)))

    return share(target) - share(raw)


def target_ids(labels: DataFrame, rows: int = TARGET_ROWS) -> np.ndarray:
    """A sample of the good documents, bounded by ``rows`` and the same for any partitioning."""
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    chosen = good.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(rows)
    return np.sort(chosen.toArrow().column(0).to_numpy().astype(np.int64))


def train(docs: DataFrame, targets: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """The log ratio of every bucket."""
    shared = docs.sparkSession.sparkContext.broadcast(targets)
    step = buckets // _BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for part in text_slices(batch):
                bucket, row = grams(part.column("text"), buckets)
                ids = part.column("doc_id")
                good = np.isin(ids.fill_null(0).to_numpy(), shared.value) & ids.is_valid().to_numpy(zero_copy_only=False)
                sums[0] += np.bincount(bucket[good[row]], minlength=buckets)
                sums[1] += np.bincount(bucket, minlength=buckets)
        cuts = [(m, b) for m in range(2) for b in range(_BLOCKS)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([m * _BLOCKS + b for m, b in cuts], pa.int32()),
                pa.array([sums[m, b * step : (b + 1) * step].tobytes() for m, b in cuts], pa.binary()),
            ],
            ["block", "counts"],
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[block] = sums.get(block, 0) + np.frombuffer(raw, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())],
            ["block", "counts"],
        )

    rows = (
        bounded_batches(docs).select("doc_id", "text").mapInArrow(count, "block int, counts binary")
        .repartition("block").mapInArrow(add, "block int, counts binary").collect()  # 16 bytes a bucket
    )
    sums = np.zeros((2, buckets), np.int64)
    for r in rows:
        m, b = divmod(r.block, _BLOCKS)
        sums[m, b * step : (b + 1) * step] = np.frombuffer(r.counts, np.int64)
    return log_ratios(sums[0].astype(float), sums[1].astype(float))


def weigh(docs: DataFrame, table: np.ndarray, temperature: float = TEMPERATURE) -> DataFrame:
    """doc_id, n_grams, log_ratio (mean per n-gram), importance."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                bucket, row = grams(part.column("text"), len(shared.value))
                n = np.bincount(row, minlength=part.num_rows)
                total = np.bincount(row, shared.value[bucket], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(total / np.maximum(n, 1)), pa.array(total / temperature)],
                    ["doc_id", "n_grams", "log_ratio", "importance"],
                )

    return bounded_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, n_grams long, log_ratio double, importance double")


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest value of the long column ``key`` (None without rows)."""
    ends = keys.agg(F.min("key"), F.max("key")).first()
    low, high = ends
    if low is None:
        return None
    while low < high:
        width = (high - low) // _INTERVALS + 1
        counts = (
            keys.filter(F.col("key").between(low, high))
            .groupBy(F.floor((F.col("key") - low) / width).alias("part")).agg(F.count(F.lit(1)).alias("n"))
            .collect()  # at most _INTERVALS rows
        )
        for row in sorted(counts, key=lambda r: -r.part):
            if k <= row.n:
                low, high = low + row.part * width, min(high, low + (row.part + 1) * width - 1)
                break
            k -= row.n
    return low


def select(weighed: DataFrame, share: float = KEEP_SHARE, seed: int = SEED) -> DataFrame:
    """Gumbel top-k: adds ``key`` and ``selected``."""
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = written(
        weighed.withColumn("key", F.col("importance") - F.log(-F.log(uniform))).withColumn(
            "_whole", F.floor(F.col("key") / _UNIT)
        ),
        "importance-keys",
    )
    at = kth_largest(keyed.select(F.col("_whole").alias("key")), math.ceil(share * keyed.count()))
    return keyed.withColumn("selected", F.col("_whole") >= F.lit(at if at is not None else 0)).drop("_whole")


def resample(docs: DataFrame, labels: DataFrame, share: float = KEEP_SHARE) -> DataFrame:
    """doc_id, n_grams, log_ratio, importance, key, selected for every row."""
    return select(weigh(docs, train(docs, target_ids(labels))), share)


def op1_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
