"""Make this repository importable in Python workers, wherever the driver was started from."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send the packages to the executors once per application, as ``--py-files`` would."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root, staging = Path(__file__).resolve().parent.parent, Path(tempfile.mkdtemp(prefix="millrace-code-"))
    for package in ("millrace", "checks"):
        shutil.copytree(root / package, staging / "src" / package, ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(str(staging / f"millrace-{app}"), "zip", staging / "src"))
    _shipped.add(app)
