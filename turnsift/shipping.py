"""Python workers import the package wherever they run."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package's code to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="turnsift-package-")) / "turnsift"
    context.addPyFile(shutil.make_archive(str(target), "zip", ROOT, "turnsift"))
    _shipped.add(context.applicationId)
