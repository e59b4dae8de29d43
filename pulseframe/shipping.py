"""Sends the package to Python workers that can't import it otherwise."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's files, once; the driver serves them to executors."""
    sc = spark.sparkContext
    if getattr(sc, "_pulseframe_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="pulseframe-"), "pulseframe.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("pulseframe", os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc._pulseframe_shipped = True
