"""Session helpers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Gives this package to the executors, once per application (as ``--py-files`` would)."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        here = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="spark-")) / "spanflow.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(here.rglob("*.py")):
                z.write(f, f.relative_to(here.parent))
        spark.sparkContext.addPyFile(str(path))
        _SHIPPED.add(app)
    return spark
