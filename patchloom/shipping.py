"""Makes this package importable on workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package to Spark, once for each application; executors fetch it, later ones too."""
    if spark.sparkContext.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    at = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="patchloom-")), "patchloom-package.zip")
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(at)
    _SHIPPED.add(spark.sparkContext.applicationId)
