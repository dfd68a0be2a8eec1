"""Ships this package to the executors of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package to the Python path of every task of the session, once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_mnemora_shipped", False):
        return
    root = Path(__file__).parent
    path = os.path.join(tempfile.mkdtemp(prefix="mnemora-"), "mnemora_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path("mnemora") / f.relative_to(root))
    sc.addPyFile(path)
    sc._mnemora_shipped = True
