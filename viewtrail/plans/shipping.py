"""Makes this package importable in Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED = "viewtrail.shipped"


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once per context."""
    sc = spark.sparkContext
    if sc.getLocalProperty(_SHIPPED) == sc.applicationId:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="viewtrail-py-")) / "viewtrail.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc.setLocalProperty(_SHIPPED, sc.applicationId)
