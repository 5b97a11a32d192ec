"""Make this package importable in Spark's Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each application.

    Workers start with their own search path; on a cluster the driver's folders are not on it.
    """
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    _SENT.add(app)
    root = Path(__file__).resolve().parent
    fd, path = tempfile.mkstemp(prefix="contiguum-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
