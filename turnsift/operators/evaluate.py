"""Evaluation of the detector on payloads and labelled texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

FLAG_AT = 0.25


def _rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def detection_counts(scored: DataFrame) -> DataFrame:
    flagged = F.count_if(F.col("score") >= FLAG_AT)
    total = F.count(F.lit(1))
    return scored.agg(total.alias("tested"), flagged.alias("detected")).select(
        "tested",
        "detected",
        (F.col("tested") - F.col("detected")).alias("missed"),
        F.round(_rate(F.col("detected"), F.col("tested")), 4).alias("detection_rate"),
    )


def detection_by_group(scored: DataFrame, *groups: str) -> DataFrame:
    """Totals and one breakdown per column in a single pass (grouping sets)."""
    sets = [[]] + [[F.col(g)] for g in groups]
    grouped = scored.groupingSets(sets, *[F.col(g) for g in groups]).agg(
        F.grouping_id().alias("_set"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("score") >= FLAG_AT).alias("detected"),
    )
    dimension = F.lit("total")
    value = F.lit("all")
    every = (1 << len(groups)) - 1
    for i, name in enumerate(groups):
        this_set = every & ~(1 << (len(groups) - 1 - i))
        dimension = F.when(F.col("_set") == this_set, F.lit(name)).otherwise(dimension)
        value = F.when(F.col("_set") == this_set, F.col(name).cast("string")).otherwise(value)
    return grouped.select(
        dimension.alias("dimension"),
        value.alias("value"),
        "total",
        "detected",
        F.round(_rate(F.col("detected"), F.col("total")), 4).alias("rate"),
    )


def rule_frequency(scored: DataFrame, rules: str = "matched_heuristics") -> DataFrame:
    return (
        scored.select(F.explode(rules).alias("rule_id"))
        .groupBy("rule_id")
        .agg(F.count(F.lit(1)).alias("hits"))
    )


def top_rules(scored: DataFrame, top: int = 15, rules: str = "matched_heuristics") -> DataFrame:
    return rule_frequency(scored, rules).orderBy(F.desc("hits"), "rule_id").limit(top)


def confusion_matrix(scored: DataFrame) -> DataFrame:
    """One row: tp, fn, fp, tn, rates, precision, recall, f1; ``label`` is 1 or 0."""
    flagged = F.col("score") >= FLAG_AT
    bad, good = F.col("label") == 1, F.col("label") == 0
    counts = scored.agg(
        F.count_if(bad & flagged).alias("tp"),
        F.count_if(bad & ~flagged).alias("fn"),
        F.count_if(good & flagged).alias("fp"),
        F.count_if(good & ~flagged).alias("tn"),
    )
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    recall = _rate(tp, tp + fn)
    precision = _rate(tp, tp + fp)
    f1 = _rate(2 * precision * recall, precision + recall)
    return counts.select(
        "tp", "fn", "fp", "tn",
        F.round(recall, 4).alias("detection_rate"),
        F.round(_rate(fp, fp + tn), 4).alias("fp_rate"),
        F.round(precision, 4).alias("precision"),
        F.round(recall, 4).alias("recall"),
        F.round(f1, 4).alias("f1"),
    )


def example_errors(scored: DataFrame, key: str, text: str, top: int = 5) -> DataFrame:
    """The first missed and the first wrongly flagged texts by key."""
    flagged = F.col("score") >= FLAG_AT
    kind = F.when((F.col("label") == 1) & ~flagged, "missed").when(
        (F.col("label") == 0) & flagged, "false_positive"
    )
    ranked = Window.partitionBy("kind").orderBy(key)
    return (
        scored.withColumn("kind", kind)
        .filter(F.col("kind").isNotNull())
        .select("kind", key, F.left(text, F.lit(200)).alias("text"), F.round("score", 4).alias("score"))
        .withColumn("nth", F.row_number().over(ranked))
        .filter(F.col("nth") <= top)
    )


def stage_times(timings: DataFrame) -> DataFrame:
    """Mean and sample deviation of measured stage times: stage, seconds."""
    return timings.groupBy("stage").agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg("seconds").alias("mean_seconds"),
        F.stddev_samp("seconds").alias("sd_seconds"),
    )
