"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Targets. Sources in code point order (null last) weigh 3, 1, 2, repeating. Together they get
``budget`` times all words. A target stops at ``most_repeats`` times its source's words; what is
cut off goes to the others by weight until none is above. That end state is one level: every
target is the smaller of its limit and ``level * weight``, so it is found by sorting the sources
by limit per weight, without rounds.

Schedule. Each source is a stream of its documents in hashed order, read again from the start
when it ends, and cut into blocks of ``block_words`` words. Slot i of the mix has the golden-ratio
point frac(i * phi); the point is looked up in the cumulative block counts of the sources, and the
k-th slot of a source delivers block k of its stream. A source's slots are spread evenly over the
whole mix, and its count is off by a logarithm of the slots at most, so every source gets that
many slots more than it has blocks; slots past its target stay empty and the last block is cut
at the target. The words taken therefore equal the rounded target, and no document is taken more
than ``most_repeats`` times.

Contract: one row per input row. Size is the number of words (null text: 0); rows without words
take 0. A null source is a source of its own. Rows with a null or repeated doc_id are rows like
any other. Equal rows are interchangeable. An empty table gives no rows. Only doc_id, source and
text are read; other columns, whatever their names, do not matter.

Scale. Texts never move: they are counted in the scan. Positions come from sums per (source,
range of the order hash), so a hot source is many small groups; slots are ranked per (source, run
of slots) in the same way. The schedule joins on (source, block), at most ``block_words`` rows a
key. What is one row per source (sums, targets) is sorted in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from turnsift.operators.durable import written

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST_REPEATS = 2
BLOCK_WORDS = 512
SEED = 20_011

_ROWS_A_RANGE = 1024
_SLOTS_A_RUN = 256
_POINTS_A_CELL = 64
#: 2**32 divided by the golden ratio, the step of the point sequence in 32-bit fractions.
_GOLDEN = 2_654_435_769
_UNIT = 1 << 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(
    sized: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most_repeats: int = MOST_REPEATS
) -> DataFrame:
    """source, sid, source_size, target: one row per source."""
    everyone = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy("per_weight", "sid")
    earlier = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_limit.rowsBetween(0, Window.unboundedFollowing)
    all_rows = by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = budget * F.sum("source_size").over(everyone)
    level = (total - F.coalesce(F.sum("cap").over(earlier), F.lit(0))) / F.sum("weight").over(rest)
    return (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("sid", F.row_number().over(by_name).cast("long"))
        .withColumn(
            "weight",
            F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int")),
        )
        .withColumn("cap", F.lit(most_repeats) * F.col("source_size"))
        .withColumn("per_weight", F.col("cap") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("capped", F.col("level") >= F.col("per_weight"))
        .withColumn(
            "final",
            F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(all_rows),
        )
        .withColumn(
            "target",
            F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
                F.least(F.col("final") * F.col("weight"), F.col("cap").cast("double"))
            ),
        )
        .select("source", "sid", "source_size", "target")
    )


def _with_blocks(sources: DataFrame, block_words: int) -> DataFrame:
    """Per source: blocks a pass, whole passes, words of the last pass, blocks needed."""
    return (
        sources.filter("source_size > 0")
        .withColumn("goal", F.round("target").cast("long"))
        .withColumn("blocks", F.ceil(F.col("source_size") / block_words))
        .withColumn("passes", F.floor(F.col("goal") / F.col("source_size")))
        .withColumn("left_over", F.col("goal") - F.col("passes") * F.col("source_size"))
        .withColumn(
            "needed", F.col("passes") * F.col("blocks") + F.ceil(F.col("left_over") / block_words)
        )
    )


def _slots(spark: SparkSession, sources: DataFrame, block_words: int) -> DataFrame:
    """sid, block, pass, upto: what every slot of the mix delivers."""
    planned = _with_blocks(sources, block_words)
    about = planned.agg(F.sum("needed"), F.count(F.lit(1))).first()
    if not about[0]:
        return spark.createDataFrame([], "sid long, block long, pass long, upto long")
    margin = 4 + math.ceil(math.log2(about[0] + 2))
    slots = int(about[0]) + margin * int(about[1])
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    planned = (
        planned.withColumn("share", F.col("needed") + margin)
        .withColumn("low", F.coalesce(F.sum("share").over(before), F.lit(0)))
        .withColumn("high", F.col("low") + F.col("share"))
    )
    cells = planned.withColumn(
        "cell",
        F.explode(F.sequence(F.floor(F.col("low") / _POINTS_A_CELL), F.floor((F.col("high") - 1) / _POINTS_A_CELL))),
    )
    step, low, high = F.col("id"), F.col("id") % 65536, F.floor(F.col("id") / 65536) % 65536
    fraction = (low * _GOLDEN + (high * _GOLDEN) % _UNIT * 65536) % _UNIT
    points = (
        spark.range(1, slots + 1)
        .select(step.alias("slot"), F.floor((fraction + 0.5) / float(_UNIT) * slots).alias("at"))
        .withColumn("cell", F.floor(F.col("at") / _POINTS_A_CELL))
    )
    dealt = points.join(cells, "cell").filter("at >= low AND at < high").select(
        "slot", (F.floor(F.col("slot") / _SLOTS_A_RUN)).alias("run"),
        "sid", "source_size", "blocks", "passes", "left_over", "needed",
    )
    earlier_runs = Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        dealt.groupBy("sid", "run")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("sid", "run", F.coalesce(F.sum("n").over(earlier_runs), F.lit(0)).alias("base"))
    )
    inside = Window.partitionBy("sid", "run").orderBy("slot")
    block_end = (F.col("block") + 1) * block_words
    limit = F.when(F.col("pass") < F.col("passes"), F.col("source_size")).otherwise(F.col("left_over"))
    return (
        dealt.withColumn("within", F.row_number().over(inside) - 1)
        .join(bases, ["sid", "run"])
        .withColumn("rank", F.col("base") + F.col("within"))
        .filter("rank < needed")
        .withColumn("pass", F.floor(F.col("rank") / F.col("blocks")))
        .withColumn("block", F.col("rank") % F.col("blocks"))
        .select("sid", "block", "pass", F.least(block_end, limit).alias("upto"))
    )


def _placed(sized: DataFrame, rows: int) -> DataFrame:
    """Rows with words and their first word's place in their source's stream."""
    bits = max(0, math.ceil(math.log2(max(1, rows) / _ROWS_A_RANGE)))
    part = F.shiftright("order", 64 - bits) if bits else F.lit(0).cast("long")
    ranged = sized.filter("size > 0").withColumn("part", part)
    earlier = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        ranged.groupBy("sid", "part")
        .agg(F.sum("size").alias("n"))
        .select("sid", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    )
    inside = (
        Window.partitionBy("sid", "part")
        .orderBy("order", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        ranged.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(bases, ["sid", "part"])
        .withColumn("start", F.col("base") + F.col("within"))
        .drop("part", "base", "within", "order")
    )


def mix(
    docs: DataFrame,
    weights=WEIGHTS,
    budget: float = BUDGET,
    most_repeats: int = MOST_REPEATS,
    block_words: int = BLOCK_WORDS,
    seed: int = SEED,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, size, source_size, target, taken and taken_by_pass (array, one count per pass) for
    every row; ``keep`` names further columns to carry along."""
    spark = docs.sparkSession
    carried = [F.col(name).alias(f"_kept_{i}") for i, name in enumerate(keep)]
    restored = [F.col(f"_kept_{i}").alias(name) for i, name in enumerate(keep)]
    keep = tuple(f"_kept_{i}" for i in range(len(keep)))
    sized = written(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *carried).withColumn(
            "order", F.xxhash64("doc_id", F.lit(seed))
        ),
        "mix-sizes",
    )
    sources = written(source_targets(sized, weights, budget, most_repeats), "mix-sources")
    named = sized.join(
        sources.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own"))
    ).drop("own", "source")
    placed = _placed(named, sized.count())
    pieces = placed.withColumn(
        "block",
        F.explode(
            F.sequence(
                F.floor(F.col("start") / block_words),
                F.floor((F.col("start") + F.col("size") - 1) / block_words),
            )
        ),
    ).withColumn("from", F.greatest("start", F.col("block") * block_words)).withColumn(
        "to", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    )
    delivered = F.greatest(F.lit(0), F.least("to", "upto") - F.col("from"))
    per_pass = [
        F.coalesce(F.sum(F.when(F.col("pass") == p, delivered)), F.lit(0)) for p in range(most_repeats)
    ]
    counted = (
        pieces.join(_slots(spark, sources, block_words), ["sid", "block"], "left")
        .groupBy("sid", "start", "doc_id", "size", "source_size", "target", *keep)
        .agg(F.array(*per_pass).alias("taken_by_pass"))
    )
    nothing = F.array(*[F.lit(0).cast("long")] * most_repeats)
    wordless = named.filter("size = 0").withColumn("taken_by_pass", nothing)
    columns = ["doc_id", "size", "source_size", "target", "taken_by_pass", *keep]
    total = F.aggregate("taken_by_pass", F.lit(0).cast("long"), lambda a, x: a + x)
    return (
        counted.select(*columns)
        .unionByName(wordless.select(*columns))
        .select("doc_id", "size", "source_size", "target", total.alias("taken"), "taken_by_pass", *restored)
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows: a row comes once for every pass that takes at least half its words, so
    most rows come 0, 1 or 2 times. Columns as given."""
    row = next(n for n in ("_row", "_mix_row", "_mix_row_") if n not in docs.columns)
    marked = written(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    copies = F.size(F.filter("taken_by_pass", lambda x: 2 * x >= F.col("size")))
    wanted = (
        mix(marked, keep=(row,), **options)
        .filter("taken > 0")
        .select(row, F.explode(F.array_repeat(F.lit(True), copies)).alias("_copy"))
    )
    return marked.join(wanted, row).select(*docs.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
