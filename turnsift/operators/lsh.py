"""Which rows have a similar reference: hash tables first, exact comparison for the rest.

Unit vectors at cosine c are ``sqrt(2 - 2c)`` apart, so projections on random directions, cut into
buckets, agree for near vectors more often than for far ones. A key joins the buckets of a few
directions (all must agree), and a pair is a candidate when any of several keys agrees. Candidates
are compared exactly, so nothing is covered that is not; a row without a hit goes to the tiles,
which compare it with every reference, so nothing is missed either. The tables only decide how
many rows need that: ``hits`` is what they find alone.

A bucket with more than ``bucket_rows`` references names no candidates (its rows are settled by
other tables or by the tiles), so a row meets at most ``tables * bucket_rows`` references however
crowded the references are. Null and empty vectors are never similar to anything.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from turnsift.operators.durable import written
from turnsift.operators.tiles import compare

#: References above which the tables come before the tiles: below, a row costs less in a tile than
#: its keys cost in a shuffle.
LSH_ABOVE = 50_000


@dataclass(frozen=True)
class HashTables:
    """``width`` is the bucket length as a share of the distance of the threshold."""

    tables: int = 16
    directions: int = 6
    width: float = 2.5
    bucket_rows: int = 64
    seed: int = 7


def _keys(hashing: HashTables, at_least: float):
    """Pandas UDF: the bucket key of a vector in every table."""
    length = hashing.width * sqrt(2 - 2 * at_least)

    @F.pandas_udf(ArrayType(LongType()))
    def keys(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        matrix = np.stack(vectors.to_numpy()).astype(float)
        rng = np.random.default_rng(hashing.seed)
        count = hashing.tables * hashing.directions
        axes = rng.standard_normal((matrix.shape[1], count))
        buckets = np.floor((matrix @ axes + rng.uniform(0, length, count)) / length).astype(np.int64)
        weights = rng.integers(1, 1 << 62, (hashing.tables, hashing.directions), dtype=np.int64)
        with np.errstate(over="ignore"):
            mixed = (buckets.reshape(len(matrix), hashing.tables, -1) * weights).sum(axis=2)
            mixed += np.arange(hashing.tables, dtype=np.int64) * np.int64(0x5851F42D4C957F2D)
        return pd.Series(list(mixed))

    return keys("vector")


@F.pandas_udf(DoubleType())
def _cosine(left: pd.Series, right: pd.Series) -> pd.Series:
    if not len(left):
        return pd.Series([], dtype=float)
    a, b = (np.stack(side.to_numpy()).astype(float) for side in (left, right))
    return pd.Series(np.round((a * b).sum(axis=1).clip(-1.0, 1.0), 12))


def hits(rows: DataFrame, refs: DataFrame, at_least: float, hashing: HashTables = HashTables()) -> DataFrame:
    """id, ref, cos of the candidates that reach the threshold. ``rows``: id, vector; ``refs``: ref,
    vector; both unit vectors of one length, read twice."""
    keys = _keys(hashing, at_least)
    left = rows.filter("size(vector) > 0").select("id", F.explode(keys).alias("key"))
    right = written(refs.filter("size(vector) > 0").select("ref", F.explode(keys).alias("key")), "lsh-buckets")
    thin = right.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= hashing.bucket_rows)
    pairs = left.join(right.join(thin.select("key"), "key"), "key").select("id", "ref").distinct()
    return (
        pairs.join(rows.select("id", F.col("vector").alias("_row")), "id")
        .join(refs.select("ref", F.col("vector").alias("_ref")), "ref")
        .withColumn("cos", _cosine("_row", "_ref"))
        .filter(F.col("cos") >= at_least)
        .select("id", "ref", "cos")
    )


def covered(
    rows: DataFrame,
    refs: DataFrame,
    at_least: float,
    lsh_above: int = LSH_ABOVE,
    hashing: HashTables = HashTables(),
    **groups,
) -> DataFrame:
    """id of every row with a reference at ``at_least`` or more. ``refs``: ref, rank, vector."""
    if refs.count() <= lsh_above:
        return compare(rows, refs, at_least, "first", **groups).select("id").distinct()
    quick = written(hits(rows, refs, at_least, hashing).select("id").distinct(), "lsh-hits")
    rest = written(rows.join(quick, "id", "left_anti").select("id", "vector"), "lsh-rest")
    return quick.unionByName(compare(rest, refs, at_least, "first", **groups).select("id").distinct())
