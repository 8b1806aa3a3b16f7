"""Send this package to the Python workers of a cluster."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Workers import the package from a zip that the session distributes, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        root = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="tesselith-code-")  # read by the driver, which serves it
        atexit.register(shutil.rmtree, folder, True)
        path = os.path.join(folder, f"{root.name}.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(path)
    return spark
