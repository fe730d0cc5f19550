"""Hard negatives by a vertical scan with branch and bound (BOND).

Rows lie in blocks that hold their vectors by dimension: one column of a block is one component of
all its rows. An anchor reads the columns in descending order of the magnitude of its own components, so the large
contributions come first. After every few columns each row has a partial score, and the columns
still to come can add no less and no more than the block's smallest and largest value of each
column allow. From these bounds the bitmap of candidate rows shrinks:

* Positives, the best ``n_positives`` rows of the anchor's label: a row goes when its upper bound is
  below the n-th best lower bound of the block.
* Negatives, per positive the best ``n_negatives`` rows of another label with a score from
  ``low_percent`` of the positive's up to the positive's: a row goes when its bounds miss all windows,
  and for a window also when its upper bound is below the n-th best lower bound of rows that lie
  in the window for sure.

Rows that are left have exact scores after the last column; windows and ranks are decided on
those. Positives of all blocks are merged before windows exist, so there are two scans.

Contract. A component x counts as floor(256 * x), a score is the integer inner product. Rows with a
null id, a null label, a null vector, a null or non-finite component (or one that is not finite times 256) take no
part. Shorter vectors count as padded with zeros, an empty vector as zeros. Higher scores come first,
ties go by smaller id; equal ids are rows of their own, each anchor row has its own result rows and
is never its own positive. A positive with a score of 0 or less has the window of that sign, which
is empty below 0. A score beyond 64 bits counts as the nearest long. An
anchor without positives or negatives gives no row, an empty table gives none. Only the three
named columns are read.

Scale. Blocks have at most ``BLOCK_VALUES`` components and are cut where the table is read. Anchors
(the query set) travel in groups of at most about ``GROUP_ROWS`` to every block; a task holds one
block and one group. What goes on from a block is at most n rows an anchor and window, and a label
that holds most rows is in all blocks alike. All pairs of blocks and groups are scored; the bounds
save columns, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from turnsift.llm.texts import bounded_batches
from turnsift.operators.durable import written

BLOCK_VALUES = 1 << 20
GROUP_ROWS = 512
STRIDE = 8
SCALE = 256
_BLOCK = "block long, n int, dims int, ids binary, rows binary, labels binary, vectors binary, small boolean"


def usable(vectors: DataFrame, vec_id: str, vector: str, label: Column) -> DataFrame:
    """vec_id, label, vector (scaled components) of the rows that take part."""
    scaled = F.transform(F.col(vector).cast("array<double>"), lambda x: x * SCALE)
    finite = F.forall(scaled, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"),
        F.when(finite, scaled).alias("vector"),
    ).filter("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")


def _columns(vectors: pa.ListArray) -> np.ndarray:
    """Floors of the components, one line a dimension."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False))
    dims = int(lengths.max(initial=0))
    out = np.zeros((dims, len(lengths)))
    row = np.repeat(np.arange(len(lengths)), lengths)
    start = np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.arange(len(flat)) - start, row] = flat
    return out


def _packed(rows: pa.RecordBatch, block: int) -> pa.RecordBatch:
    columns = _columns(rows.column("vector"))
    small = bool(np.abs(columns).max(initial=0) < 1 << 15)
    cells = [
        block, rows.num_rows, len(columns),
        *(rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for c in ("vec_id", "row", "label")),
        columns.astype(np.int16 if small else np.float64).tobytes(), small,
    ]
    kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.bool_()]
    names = ["block", "n", "dims", "ids", "rows", "labels", "vectors", "small"]
    return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's rows as blocks; a block is named by its first row."""
    held, values = [], 0

    def packed() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return _packed(rows, rows.column("row")[0].as_py())

    for batch in batches:
        ends = batch.column("vector").offsets.to_numpy()
        start = 0
        while start < batch.num_rows:
            room = max(0, BLOCK_VALUES - values)
            stop = int(np.searchsorted(ends, ends[start] + room, "right")) - 1
            stop = min(batch.num_rows, max(stop, start if held else start + 1))
            if stop > start:
                held.append(batch.slice(start, stop - start))
                values += int(ends[stop] - ends[start])
            if stop < batch.num_rows:
                yield packed()
                held, values = [], 0
            start = stop
    if held:
        yield packed()


class _Table:
    """A block or a group of anchors: ids, row numbers, labels, vectors by dimension."""

    def __init__(self, cells: dict, prefix: str = "") -> None:
        get = lambda name: cells[prefix + name]
        self.ids, self.rows, self.labels = (np.frombuffer(get(c), np.int64) for c in ("ids", "rows", "labels"))
        kind = np.int16 if get("small") else np.float64
        self.columns = np.frombuffer(get("vectors"), kind).reshape(get("dims"), get("n")).astype(np.float64)


def _exact(anchors: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with one number of dimensions, in a type that holds every score exactly."""
    dims = max(len(anchors), len(block))
    anchors, block = (np.pad(x, ((0, dims - len(x)), (0, 0))) for x in (anchors, block))
    most = float(np.abs(anchors).max(axis=1, initial=0) @ np.abs(block).max(axis=1, initial=0))
    if most < 1 << 50:
        return anchors, block
    whole = np.frompyfunc(int, 1, 1)
    return whole(anchors), whole(block)


def _as_long(scores: np.ndarray) -> np.ndarray:
    return scores if scores.dtype != object else np.clip(scores, -(2**63), 2**63 - 1)


def _nth_best(values: np.ndarray, n: int):
    """The n-th largest value, or None of fewer."""
    if len(values) < n:
        return None
    if values.dtype == object:
        return sorted(values)[-n]
    return np.partition(values, len(values) - n)[-n]


class _Scan:
    """One block, read by dimension for one anchor after another."""

    def __init__(self, block: np.ndarray) -> None:
        self.block = block
        self.least, self.most = (
            (block.min(axis=1), block.max(axis=1)) if block.size else (np.zeros(len(block)), np.zeros(len(block)))
        )

    def steps(self, anchor: np.ndarray, alive: np.ndarray):
        """(rows alive, partial scores, least and most that is to come) after every few columns;
        the caller sends back which of them stay."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = np.stack((anchor * self.least, anchor * self.most))
        low, high = ends.min(axis=0)[order], ends.max(axis=0)[order]
        score = np.zeros(len(alive), self.block.dtype)
        for start in range(0, len(order), STRIDE):
            dims = order[start : start + STRIDE]
            part = self.block[dims]
            score = score + anchor[dims] @ (part if len(alive) == part.shape[1] else part[:, alive])
            rest = slice(start + STRIDE, None)
            stay = yield alive, score, low[rest].sum(), high[rest].sum()
            if stay is not None:
                alive, score = alive[stay], score[stay]
        return alive, score


def _finish(steps, judge) -> tuple[np.ndarray, np.ndarray]:
    """Run a scan, dropping what ``judge`` drops; the rows left and their exact scores."""
    stay = None
    while True:
        try:
            alive, score, low, high = steps.send(stay)
        except StopIteration as end:
            alive, score = end.value
            return alive, _as_long(score)
        stay = judge(_as_long(score + low), _as_long(score + high))


def _top(ids: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:n]


def _best_of_label(scan: _Scan, block: _Table, vector, label: int, row: int, n: int):
    alive = np.flatnonzero((block.labels == label) & (block.rows != row))

    def judge(lower, upper):
        bar = _nth_best(lower, n)
        return None if bar is None else upper >= bar

    alive, score = _finish(scan.steps(vector, alive), judge)
    order = _top(block.ids[alive], score, n)
    return alive[order], score[order]


def _best_in_windows(scan: _Scan, block: _Table, vector, label: int, positives: list[int], percent: int, n: int):
    """Per window the best rows of another label."""
    alive = np.flatnonzero(block.labels != label)
    windows = [(-(-percent * p // 100), p) for p in positives]

    def judge(lower, upper):
        stay = np.zeros(len(lower), bool)
        for low, high in windows:
            inside = (lower >= low) & (upper <= high)
            bar = _nth_best(lower[inside], n)
            floor = low if bar is None else max(low, bar)
            stay |= (upper >= floor) & (lower <= high)
        return stay

    alive, score = _finish(scan.steps(vector, alive), judge)
    for low, high in windows:
        fits = np.flatnonzero((score >= low) & (score <= high))
        order = fits[_top(block.ids[alive[fits]], score[fits], n)]
        yield alive[order], score[order]


def _long_table(out: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(map(int, c), pa.int64()) for c in columns], names)


def _positives(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cells in batch.to_pylist():
            block, group = _Table(cells), _Table(cells, "a_")
            anchors, columns = _exact(group.columns, block.columns)
            scan, out = _Scan(columns), []
            for i, (row, label) in enumerate(zip(group.rows.tolist(), group.labels.tolist(), strict=True)):
                at, score = _best_of_label(scan, block, anchors[:, i], label, row, n)
                out += [(row, block.ids[j], block.rows[j], s) for j, s in zip(at, score, strict=True)]
            yield _long_table(out, ["anchor_row", "positive_id", "positive_row", "positive_score"])


def _negatives(batches: Iterator[pa.RecordBatch], percent: int, n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cells in batch.to_pylist():
            block, group = _Table(cells), _Table(cells, "a_")
            scores = {w["row"]: w["scores"] for w in cells["windows"]}
            anchors, columns = _exact(group.columns, block.columns)
            scan, out = _Scan(columns), []
            for i, (row, label) in enumerate(zip(group.rows.tolist(), group.labels.tolist(), strict=True)):
                if row not in scores:
                    continue
                found = _best_in_windows(scan, block, anchors[:, i], label, scores[row], percent, n)
                for place, (at, score) in enumerate(found, 1):
                    out += [(row, place, block.ids[j], s) for j, s in zip(at, score, strict=True)]
            yield _long_table(out, ["anchor_row", "place", "negative_id", "negative_score"])


def _first(rows: DataFrame, keys: list[str], order: list[Column], n: int, place: str) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(place, F.row_number().over(window)).filter(F.col(place) <= n)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    n_positives: int = 5,
    n_negatives: int = 5,
    low_percent: int = 80,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``is_anchor`` is over
    vec_id and label, ``label`` over the columns of ``vectors``."""
    rows = written(
        usable(vectors, vec_id, vector, label).withColumn("row", F.monotonically_increasing_id()), "bond-rows"
    )
    blocks = written(bounded_batches(rows).mapInArrow(_blocks, _BLOCK), "bond-blocks")
    chosen = rows.filter(is_anchor)
    n_groups = -(-chosen.count() // GROUP_ROWS) or 1
    anchors = chosen.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(n_groups)))
    groups = written(
        anchors.groupBy("group").applyInArrow(_group, _BLOCK.replace("block long", "group long")), "bond-anchors"
    )
    groups = groups.select("group", *(F.col(c).alias(f"a_{c}") for c in groups.columns if c != "group"))
    # the query set against all rows, in blocks
    pairs = blocks.crossJoin(groups)
    best = bounded_batches(pairs).mapInArrow(
        partial(_positives, n=n_positives),
        "anchor_row long, positive_id long, positive_row long, positive_score long",
    )
    positives = written(
        _first(
            best, ["anchor_row"], [F.desc("positive_score"), F.col("positive_id"), F.col("positive_row")],
            n_positives, "place",
        ).withColumn("place", F.col("place").cast("long")),
        "bond-positives",
    )
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("place", "positive_score"))), lambda x: x.positive_score)
    windows = (
        positives.groupBy(F.col("anchor_row").alias("row"))
        .agg(in_order.alias("scores"))
        .join(anchors.select("row", "group"), "row")
        .groupBy("group")
        .agg(F.collect_list(F.struct("row", "scores")).alias("windows"))
    )
    wanted = written(groups.join(windows, "group"), "bond-windows")
    below = bounded_batches(blocks.crossJoin(wanted)).mapInArrow(
        partial(_negatives, percent=low_percent, n=n_negatives),
        "anchor_row long, place long, negative_id long, negative_score long",
    )
    negatives = _first(
        below, ["anchor_row", "place"], [F.desc("negative_score"), F.col("negative_id")], n_negatives, "rank"
    )
    return (
        negatives.join(positives, ["anchor_row", "place"])
        .join(anchors.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id")), "anchor_row")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def _group(rows: pa.Table) -> pa.Table:
    batch = rows.combine_chunks().to_batches()[0]
    packed = _packed(batch, batch.column("group")[0].as_py())
    return pa.Table.from_batches([packed.rename_columns(["group", *packed.schema.names[1:]])])


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0, label)


ORACLE = """
WITH scaled AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS double))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    CAST(list_inner_product(a.v, b.v) AS bigint) AS score
  FROM scaled a JOIN scaled b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS integer) AS rank, other AS negative_id,
  positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 5
"""
