"""Cutting lineage in a place that survives the loss of executors.

Everything goes to the folder named by ``spark.checkpoint.dir``, which the driver and all
executors share. There is no other mode: a session without that setting is an error here, and
only scripts that own their session (tests, bench, the entry module) call
``own_folder_if_unset`` first.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[str]] = []


def _named_folder(spark: SparkSession) -> str | None:
    context = spark.sparkContext
    return spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )


def own_folder_if_unset(spark: SparkSession) -> None:
    """For single-machine sessions that name no folder; a cluster must name one."""
    if spark.sparkContext.getCheckpointDir() or _named_folder(spark):
        return
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="turnsift-checkpoint-"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of this application."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = _named_folder(spark)
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of the rows (never a local one)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """The rows as a Parquet table in the shared folder, reread: columnar and compressed, so
    the better choice for wide rows and for what several branches read. Inside ``scratch`` the
    table goes at the end unless ``keep``."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes and not keep:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables written inside. A result that reads them has to be stored before."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
