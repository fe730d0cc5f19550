"""Model stage: a Spark ML classifier, or any Python model behind an Arrow UDF."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from turnsift.operators.detect import Scorer
from turnsift.operators.durable import written

#: Working columns of the pipeline.
_STAGES = tuple(
    f"_model_{name}" for name in ("text", "words", "counts", "vector", "raw", "probability", "prediction")
)

def train(labelled: DataFrame, text: str, label: str, features: int = 1 << 16) -> PipelineModel:
    """Logistic regression on hashed words; ``label`` is 1 for an injection."""
    rows = labelled.select(
        F.coalesce(text, F.lit("")).alias(_STAGES[0]), F.col(label).cast("double").alias("_model_label")
    )
    given, words, counts, vector, raw, probability, prediction = _STAGES
    hashing = [
        RegexTokenizer(inputCol=given, outputCol=words, pattern=r"\W+"),
        HashingTF(inputCol=words, outputCol=counts, numFeatures=features),
    ]
    # the texts are read once: what follows passes over the counts several times
    hashed = written(PipelineModel(hashing).transform(rows).select(counts, "_model_label"), "model-counts")
    fitted = Pipeline(
        stages=[
            IDF(inputCol=counts, outputCol=vector),
            LogisticRegression(
                regParam=0.01, maxIter=30, labelCol="_model_label", featuresCol=vector,
                rawPredictionCol=raw, probabilityCol=probability, predictionCol=prediction,
            ),
        ]
    ).fit(hashed)
    return PipelineModel([*hashing, *fitted.stages])


def scorer(model: PipelineModel) -> Scorer:
    """Adds ml_score, the probability of class 1 on the whole text. Other columns are kept,
    whatever their names; an older ml_score is replaced."""

    def score(df: DataFrame, text: str) -> DataFrame:
        scored = model.transform(df.withColumn(_STAGES[0], F.coalesce(text, F.lit(""))))
        return scored.withColumn("ml_score", vector_to_array(_STAGES[5])[1]).drop(*_STAGES)

    return score


def python_scorer(load: Callable[[], Callable[[Sequence[str]], Sequence[float]]]) -> Scorer:
    """``load`` runs once per Python worker and returns a batch scoring function."""

    @F.pandas_udf(DoubleType())
    def score_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = load()
        for texts in batches:
            yield pd.Series(list(predict(texts.tolist())), dtype="float64")

    def score(df: DataFrame, text: str) -> DataFrame:
        return df.withColumn("ml_score", score_batches(F.coalesce(text, F.lit(""))))

    return score


def injection_probability(label: Column, score: Column) -> Column:
    """Classifier output as a probability of injection, whichever class it names."""
    positive = label.endswith("1") | F.lower(label).isin("injection", "positive", "malicious")
    return F.when(positive, score).otherwise(1.0 - score)
