"""Python workers must be able to import this package, wherever the session runs."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's code to the executors, once for each Spark application. The driver serves the archive itself."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    handle, path = tempfile.mkstemp(prefix=f"{_PACKAGE.name}-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted(_PACKAGE.rglob("*.py")):
            archive.write(source, source.relative_to(_PACKAGE.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
