"""Gets this package to the Python workers of a session, wherever they run and whatever their path is."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's source files to the session, once an application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = Path(__file__).resolve().parent
    if not root.is_dir():
        return  # it was loaded from an archive that is shipped already
    folder = tempfile.mkdtemp(prefix="ship-")  # the driver hands it to the workers
    atexit.register(shutil.rmtree, folder, True)
    path = Path(folder) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, f"{root.name}/{file.relative_to(root)}")
    context.addPyFile(str(path))


def map_in_arrow(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    ship(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def map_in_pandas(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    ship(rows.sparkSession)
    return rows.mapInPandas(run, schema)
