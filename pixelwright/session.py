"""Making the package known to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers of a session that would not find it by themselves.

    Workers see the driver's working directory (local runs) and PYTHONPATH; in any other case
    the package goes out once per application as a zip, through Spark's own file server.
    """
    paths = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(ROOT) in paths or os.getcwd() == str(ROOT):
        return
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    name = os.path.join(tempfile.mkdtemp(prefix="pixelwright-"), "pixelwright.zip")
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted((ROOT / "pixelwright").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    context.addPyFile(name)
