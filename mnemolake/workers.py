"""Python stages that find this package on every executor."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hands this package to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="package-")
    archive = os.path.join(folder, f"{_PACKAGE.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(_PACKAGE.rglob("*.py")):
            z.write(path, f"{_PACKAGE.name}/{path.relative_to(_PACKAGE)}")
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def map_batches(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """`df.mapInArrow` whose function may use this package."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)
