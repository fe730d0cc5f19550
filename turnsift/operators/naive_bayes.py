"""Multinomial naive Bayes as grouped counts: training is one aggregation, scoring a join.

Words are runs of ``[a-z0-9]`` after A-Z is lower-cased. The weight of a word is the log of the ratio
of its smoothed shares in the two classes; a text's log odds are the prior plus the weights of its
words, each as often as it occurs. Words that training never saw say nothing. The probability of
class 1 is the logistic function of the log odds. Null texts have no words, null labels do not train.
Without rows of a class there is nothing to tell apart and every probability is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, functions as F

from turnsift.operators.detect import Scorer
from turnsift.operators.durable import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words whose weights are broadcast, the most frequent ones (about 50 bytes each).
BROADCAST_WORDS = 200_000


@dataclass(frozen=True)
class WordWeights:
    """``table``: word, weight, n (how often it was seen), a written table of ``words`` rows; ``prior`` is the log odds of the classes."""

    table: DataFrame
    words: int
    prior: float


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit("([a-z0-9]+)"))


def train(labelled: DataFrame, text: str, label: str, smoothing: float = 1.0) -> WordWeights:
    """``label`` is 1 for an injection, 0 for anything else."""
    rows = labelled.filter(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("y"), F.col(text).alias("t"))
    counts = written(
        rows.select("y", F.explode(words_of(F.col("t"))).alias("word")).groupBy("word").agg(
            F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0")
        ),
        "nb-counts",
    )
    totals = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n1"), F.lit(0)), F.coalesce(F.sum("n0"), F.lit(0))).first()
    docs = rows.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("one"), F.coalesce(F.sum(1 - F.col("y")), F.lit(0)).alias("none")).first()
    both = bool(docs.one and docs.none)

    def share(n: str, total: int) -> Column:
        return (F.col(n) + smoothing) / (total + smoothing * totals[0])

    weight = F.log(share("n1", totals[1])) - F.log(share("n0", totals[2])) if both else F.lit(0.0)
    table = written(counts.select("word", weight.alias("weight"), (F.col("n1") + F.col("n0")).alias("n")), "nb-weights")
    return WordWeights(table, totals[0], log(docs.one / docs.none) if both else 0.0)


def _split(weights: WordWeights, most: int) -> DataFrame:
    """word, weight of the ``most`` words that occur most often, about."""
    if weights.words <= most:
        return weights.table.select("word", "weight")
    above = weights.table.approxQuantile("n", [1 - most / weights.words], 0.001)[0]
    return weights.table.filter(F.col("n") > above).select("word", "weight")


def probability(df: DataFrame, key: str, text: str, weights: WordWeights) -> DataFrame:
    """key, ml_score of every row; ``key`` is unique.

    Frequent words meet their weights, which are broadcast, where the text is read, and are summed there.
    Only the other words are shuffled, counted per row, so a long text of few words is few rows.
    """
    words = df.select(F.col(key).alias("_key"), F.posexplode_outer(words_of(F.col(text))).alias("_at", "word"))
    frequent = _split(weights, BROADCAST_WORDS).withColumnRenamed("weight", "_weight")
    more = weights.words > BROADCAST_WORDS
    rest = F.when(F.lit(more) & F.col("_weight").isNull(), F.col("word"))
    met = (
        words.join(F.broadcast(frequent), "word", "left")
        .groupBy("_key", rest.alias("word"))
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum("_weight").alias("_odds"),
            F.count_if(F.coalesce("_at", F.lit(0)) == 0).alias("_rows"),
        )
    )
    if more:
        met = written(met, "nb-words")
        rare = met.filter("word IS NOT NULL").join(weights.table.select("word", "weight"), "word").select(
            "_key", (F.col("n") * F.col("weight")).alias("_odds"), F.lit(0).cast("long").alias("_rows")
        )
        met = met.select("_key", "_odds", "_rows").filter("_rows > 0 OR _odds IS NOT NULL").unionByName(rare)
    total = F.lit(weights.prior) + F.coalesce("_odds", F.lit(0.0))
    return (
        met.groupBy("_key").agg(F.sum("_odds").alias("_odds"), F.sum("_rows").alias("_rows"))
        .select(
            F.col("_key").alias(key), (0.5 * (1 + F.tanh(total / 2))).alias("ml_score"),
            F.explode(F.sequence(F.lit(1), F.col("_rows"))).alias("_row"),
        )
        .drop("_row")
    )


def scorer(weights: WordWeights, key: str, rows: DataFrame | None = None) -> Scorer:
    """For the scan operators: adds ml_score by a join on the unique column ``key``. With ``rows``, the
    scanned rows as they are read, words are taken from those and the scan is not run for them again."""

    def score(df: DataFrame, text: str) -> DataFrame:
        return df.drop("ml_score").join(probability(df if rows is None else rows, key, text, weights), key)

    return score
