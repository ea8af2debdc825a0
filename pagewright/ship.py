"""Sends the library to the executors, so its Python functions run wherever the session does."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Once for each context: the package, as a zip file on the workers' path."""
    sc = spark.sparkContext
    if getattr(sc, "_pagewright_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="pagewright-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/pagewright-library.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(ROOT.rglob("*.py")):
            z.write(f, f.relative_to(ROOT.parent))
        for f in ROOT.parent.glob("corpus_*.py"):
            z.write(f, f.name)
    sc.addPyFile(f"{folder}/pagewright-library.zip")
    sc._pagewright_shipped = True
