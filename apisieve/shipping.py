"""Puts this package where Python workers can import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the application as a zip, unless workers find it by their path already."""
    path = {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    app = spark.sparkContext.applicationId
    if ROOT in path or Path.cwd().resolve() == ROOT or app in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="apisieve-")) / "apisieve.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in (ROOT / "apisieve").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
