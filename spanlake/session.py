"""Makes this package importable on the executors of a session."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    folder = tempfile.mkdtemp(prefix="spanlake-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    root = Path(__file__).resolve().parent
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/spanlake", "zip", root.parent, root.name))
