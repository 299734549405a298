"""Makes this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each application.

    Where ``PYTHONPATH`` has the package's folder, workers find it there already.
    """
    sc = spark.sparkContext
    if ROOT in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_keyloom_shipped", False):
        return
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="keyloom-")), "keyloom_sources.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(ROOT, "keyloom")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, ROOT))
    sc.addPyFile(path)
    sc._keyloom_shipped = True
