"""Gives executors this package, so that Python workers can import it wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession | None = None) -> None:
    """Once per application; an operator that runs Python in tasks calls it, so a session from elsewhere needs no set-up."""
    spark = spark or SparkSession.getActiveSession()
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="sparkfolio-"), "sparkfolio_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("sparkfolio", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
