"""Comparing all rows with all reference vectors as tiles of a grid.

Rows are dealt to row groups and references to reference groups of bounded size; a tile is one
of each. Spark shuffles a reference once per row group and a row once per reference group, and
a task holds one tile's references and streams the rows past them as matrix products. Nothing
passes through the driver, and every reference that reaches the threshold is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

ROW_GROUP = 65_536
REF_GROUP = 16_384
MOST_TASKS = 20_000

_AT_ONCE = 128
_LEAST_ROWS = 256
_OUT = "id string, ref string, rank string, cos double"
_DIGITS = 12


def grid(n_rows: int, n_refs: int, row_group: int, ref_group: int, tasks: int) -> tuple[int, int]:
    """Row groups and reference groups: at most the given sizes, and as many tiles as ``tasks``
    unless row groups would fall below ``_LEAST_ROWS``."""
    down, across = max(1, -(-n_rows // row_group)), max(1, -(-n_refs // ref_group))
    wanted = max(down, -(-tasks // across))
    return max(down, min(wanted, n_rows // _LEAST_ROWS)), across


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


_Picks = tuple[np.ndarray, np.ndarray]


def _best(scores: np.ndarray, at_least: float) -> _Picks:
    """The best reference of each row, the first in rank among equals."""
    top = scores.argmax(axis=1)
    good = np.flatnonzero(scores[np.arange(len(top)), top] >= at_least)
    return good, top[good]


def _first(scores: np.ndarray, at_least: float) -> _Picks:
    """The first reference in rank that reaches the threshold."""
    near = scores >= at_least
    at = near.argmax(axis=1)
    good = np.flatnonzero(near[np.arange(len(at)), at])
    return good, at[good]


def _climb(scores: np.ndarray, at_least: float) -> _Picks:
    """Every reference that beats all references before it in rank."""
    before = np.maximum.accumulate(scores, axis=1)
    before = np.hstack([np.full((len(scores), 1), -np.inf), before[:, :-1]])
    return np.nonzero((scores > before) & (scores >= at_least))


_CHOICES = {"best": _best, "first": _first, "climb": _climb}


def compare(
    rows: DataFrame,
    refs: DataFrame,
    at_least: float,
    choose: str,
    row_group: int = ROW_GROUP,
    ref_group: int = REF_GROUP,
) -> DataFrame:
    """id, ref, rank, cos of the references each row chooses per tile.

    rows: id (string), vector; refs: ref (string), rank (string, the order of references),
    vector. ``choose`` is "best", "first" or "climb"; ``best_of`` and ``first_of`` merge the tiles'
    choices.
    """
    pick = _CHOICES[choose]
    cores = rows.sparkSession.sparkContext.defaultParallelism
    n_rows, n_refs = grid(rows.count(), refs.count(), row_group, ref_group, cores)
    lines, columns = F.sequence(F.lit(0), F.lit(n_rows - 1)), F.sequence(F.lit(0), F.lit(n_refs - 1))
    left = rows.select(
        F.pmod(F.xxhash64("id"), F.lit(n_rows)).cast("int").alias("i"), F.explode(columns).alias("j"),
        F.lit(1).alias("kind"), F.lit("").alias("rank"), F.col("id").alias("name"), "vector",
    )
    right = refs.select(
        F.explode(lines).alias("i"), F.pmod(F.xxhash64("ref"), F.lit(n_refs)).cast("int").alias("j"),
        F.lit(0).alias("kind"), "rank", F.col("ref").alias("name"), "vector",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, names, ranks, blocks, matrix = None, [], [], [], None
        for batch in batches:
            i, j, kind = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("i", "j", "kind"))
            cuts = np.flatnonzero((np.diff(i) != 0) | (np.diff(j) != 0) | (np.diff(kind) != 0)) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(i)]):
                if stop == start:
                    continue
                part = batch.slice(start, stop - start)
                if (i[start], j[start]) != tile:
                    tile, names, ranks, blocks, matrix = (i[start], j[start]), [], [], [], None
                if kind[start] == 0:
                    names += part.column("name").to_pylist()
                    ranks += part.column("rank").to_pylist()
                    blocks.append(_vectors(part.column("vector")))
                    continue
                if not names:
                    continue
                if matrix is None:
                    matrix, blocks = np.vstack(blocks).T, []
                own = part.column("name").to_pylist()
                vectors = _vectors(part.column("vector"))
                for at in range(0, len(own), _AT_ONCE):
                    scores = vectors[at : at + _AT_ONCE] @ matrix
                    np.round(np.clip(scores, -1.0, 1.0, out=scores), _DIGITS, out=scores)
                    rows_of, found = pick(scores, at_least)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([own[at + k] for k in rows_of], pa.string()),
                            pa.array([names[c] for c in found], pa.string()),
                            pa.array([ranks[c] for c in found], pa.string()),
                            pa.array(scores[rows_of, found], pa.float64()),
                        ],
                        ["id", "ref", "rank", "cos"],
                    )

    return (
        left.unionByName(right)
        .repartition(min(n_rows * n_refs, MOST_TASKS), "i", "j").sortWithinPartitions("i", "j", "kind", "rank")
        .mapInArrow(run, _OUT)
    )


def best_of(found: DataFrame) -> DataFrame:
    """id, ref, cos: the best choice of each row over all tiles."""
    return found.groupBy("id").agg(
        F.min_by(F.struct("ref", "cos"), F.struct(-F.col("cos"), F.col("rank"))).alias("top")
    ).select("id", "top.ref", "top.cos")


def first_of(found: DataFrame) -> DataFrame:
    """id, rank: the first choice of each row over all tiles."""
    return found.groupBy("id").agg(F.min("rank").alias("rank"))
