"""A folder that every executor can reach, for files that one step writes and another reads."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: str | None = None


def folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; a local master without that setting has one machine, so a temporary folder will do."""
    global _LOCAL
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        if _LOCAL is None:
            made = tempfile.mkdtemp(prefix="pixelwright-files-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            _LOCAL = "file://" + made
        root = _LOCAL
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
