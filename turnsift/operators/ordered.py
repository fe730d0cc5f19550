"""Order-dependent columns for sessions of any length.

A plain ``Window.partitionBy(session)`` puts a whole session into one task. Here a session
is cut into chunks along its order; the window runs inside (session, chunk) and only one
small row per chunk travels between chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnsift.operators.durable import written

CHUNK_ROWS = 10_000


def _marked(df: DataFrame, keys: Sequence[str], chunk: Column) -> DataFrame:
    """Add _key and _chunk. The struct of the keys is never null itself, so rows whose key is null
    join like any other, and windows and joins on it share one partitioning."""
    return df.withColumn("_key", F.struct(*keys)).withColumn("_chunk", chunk)


def chunk_of(number: Column, width: int = CHUNK_ROWS) -> Column:
    """Chunk of a turn number or position."""
    return F.coalesce(F.floor(number / width).cast("long"), F.lit(-1).cast("long"))


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, out: str = "pos"
) -> DataFrame:
    """0-based dense position of every row inside its key.

    ``order`` must be a total order inside a key and ``chunk`` must not decrease along it.
    """
    marked = _marked(df, keys, chunk)
    before = Window.partitionBy("_key").orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        marked.groupBy("_key", "_chunk")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_key", "_chunk", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    )
    inside = Window.partitionBy("_key", "_chunk").orderBy(*order)
    return (
        marked.withColumn("_within", F.row_number().over(inside) - 1)
        .join(offsets, ["_key", "_chunk"])
        .withColumn(out, (F.col("_base") + F.col("_within")).cast("long"))
        .drop("_key", "_chunk", "_within", "_base")
    )


def with_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "pos") -> DataFrame:
    """0-based dense position of every row inside its key, whatever its order looks like.

    Rows are dealt in ranges of (key, order), so a key whose rows all lie in one second is as many
    tasks as it needs; only one row per key and range travels to place the ranges. ``order`` should be
    unique in a key: equal rows share a range.
    """
    columns = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    placed = written(
        df.repartitionByRange(*columns).sortWithinPartitions(*columns)
        .withColumn("_at", F.monotonically_increasing_id()).withColumn("_key", F.struct(*keys)),
        "ranked-rows",
    ).withColumn("_chunk", F.shiftright("_at", 33))
    before = Window.partitionBy("_key").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        placed.groupBy("_key", "_chunk")
        .agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .select(
            "_key", "_chunk",
            (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_base"),
        )
    )
    return (
        placed.join(bases, ["_key", "_chunk"])
        .withColumn(out, (F.col("_at") + F.col("_base")).cast("long"))
        .drop("_key", "_chunk", "_at", "_base")
    )


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    columns: Sequence[str],
    out: str = "previous",
) -> DataFrame:
    """Add a struct with ``columns`` of the row before in the same key (null for the first)."""
    marked = _marked(df, keys, chunk).withColumn("_seen", F.struct(*columns))
    chunks = Window.partitionBy("_key").orderBy("_chunk")
    tails = (
        marked.groupBy("_key", "_chunk")
        .agg(F.max_by("_seen", F.struct(*order)).alias("_tail"))
        .select("_key", "_chunk", F.lag("_tail").over(chunks).alias("_carried"))
    )
    inside = Window.partitionBy("_key", "_chunk").orderBy(*order)
    return (
        marked.withColumn("_near", F.lag("_seen").over(inside))
        .join(tails, ["_key", "_chunk"])
        .withColumn(out, F.coalesce("_near", "_carried"))
        .drop("_key", "_chunk", "_seen", "_near", "_carried")
    )


def with_running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    aggregates: dict[str, tuple],
) -> DataFrame:
    """Running aggregates up to and including the current row.

    ``aggregates`` maps an output name to (function, column), where the function also
    combines its own results: F.sum, F.max or F.min.
    """
    marked = _marked(df, keys, chunk)
    before = Window.partitionBy("_key").orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    inside = (
        Window.partitionBy("_key", "_chunk")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    names = list(aggregates)
    totals = marked.groupBy("_key", "_chunk").agg(
        *[fn(column).alias(f"_t_{name}") for name, (fn, column) in aggregates.items()]
    )
    carried = totals.select(
        "_key",
        "_chunk",
        *[aggregates[n][0](f"_t_{n}").over(before).alias(f"_c_{n}") for n in names],
    )
    local = marked.select(
        "*", *[fn(column).over(inside).alias(f"_l_{n}") for n, (fn, column) in aggregates.items()]
    )
    joined = local.join(carried, ["_key", "_chunk"])
    merged = {n: _combine(aggregates[n][0], F.col(f"_c_{n}"), F.col(f"_l_{n}")) for n in names}
    return joined.withColumns(merged).drop(
        "_key", "_chunk", *[f"_c_{n}" for n in names], *[f"_l_{n}" for n in names]
    )


def _combine(fn, carried: Column, local: Column) -> Column:
    if fn is F.sum:
        return F.coalesce(carried + local, carried, local)
    if fn is F.max:
        return F.greatest(carried, local)
    if fn is F.min:
        return F.least(carried, local)
    raise ValueError("running aggregates combine only sum, max and min")


def with_last_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    columns: Sequence[str],
    size: int,
    out: str = "last_rows",
    source: DataFrame | None = None,
) -> DataFrame:
    """Add an array of structs of ``columns``: the last ``size`` rows up to the current one.

    The rows are shuffled once, by (key, chunk). Only keys with several chunks hand the last
    size - 1 rows of each chunk on to the next ones; both branches read the same shuffle.
    ``source`` is any table with the same keys and chunks that is cheaper to read than ``df``.
    """
    marked = _marked(df, keys, chunk).withColumn("_seen", F.struct(*columns))
    inside = Window.partitionBy("_key", "_chunk").orderBy(*order)
    local = marked.withColumns(
        {
            "_n": F.row_number().over(inside),
            "_near": F.collect_list("_seen").over(inside.rowsBetween(-(size - 1), 0)),
            "_ahead": F.lead(F.lit(True), size - 1).over(inside) if size > 1 else F.lit(True),
        }
    )
    if size < 2:
        return local.withColumn(out, F.col("_near")).drop("_key", "_chunk", "_seen", "_n", "_near", "_ahead")
    chunks = (df if source is None else source).select(F.struct(*keys).alias("_key"), chunk.alias("_chunk"))
    several = chunks.groupBy("_key").agg((F.min("_chunk") < F.max("_chunk")).alias("_several")).filter("_several")
    whole = F.struct("_n", *df.columns, "_seen")  # all columns, so that both branches share the shuffle
    tails = (
        local.filter(F.col("_ahead").isNull())
        .groupBy("_key", "_chunk").agg(F.sort_array(F.collect_list(whole)).alias("_tail"))
        .select("_key", "_chunk", F.transform("_tail", lambda r: r["_seen"]).alias("_tail"))
        .join(several.select("_key"), "_key", "left_semi")
    )
    before = Window.partitionBy("_key").orderBy("_chunk").rowsBetween(-(size - 1), -1)
    earlier = F.flatten(F.collect_list("_tail").over(before))
    carried = tails.select("_key", "_chunk", F.slice(F.reverse(earlier), 1, size - 1).alias("_carried"))
    joined = local.join(carried, ["_key", "_chunk"], "left")
    back = F.reverse(F.slice("_carried", 1, F.greatest(F.lit(0), F.lit(size) - F.col("_n"))))
    complete = F.when(F.col("_carried").isNotNull() & (F.col("_n") < size), F.concat(back, "_near"))
    return joined.withColumn(out, F.coalesce(complete, "_near")).drop(
        "_key", "_chunk", "_seen", "_n", "_near", "_ahead", "_carried"
    )
