"""From raw documents to token ids: language, exact copies, near copies, source mix, byte-level BPE.

``STAGES`` lists (name, function); every function takes (spark, docs, sf_dir) and returns a
DataFrame, which ``run`` writes as Parquet and reads again as the next stage's docs. All stages
but the last return the columns of documents.

* language: rows whose text is in no learned language, or without letters, go.
* exact_copies: of equal texts (A-Z lower-cased) the row with the largest doc_id stays.
* near_copies: of each group linked by 0.8 of their five-word shingles the smallest doc_id stays.
* source_mix: rows come as often as the mix of sources takes them: not at all, once or twice.
* tokens: doc_id, lang, source, n_tokens, ids, and whether the ids decode to the text's bytes.

An empty table passes through all stages. Extra columns are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnsift.llm import byte_bpe, exact_dedup, language_id, mixing, ngram_join
from turnsift.operators.durable import own_folder_if_unset, scratch, written
from turnsift.shipping import ship_package


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs)


def _exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def _near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_first(docs)


def _source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(docs)


STAGES = [
    ("language", _language),
    ("exact_copies", _exact_copies),
    ("near_copies", _near_copies),
    ("source_mix", _source_mix),
    ("tokens", _tokens),
]

#: A trained model, link components and a tokenizer have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every stage's result is a written table."""
    own_folder_if_unset(spark)
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
    return docs
