"""The package on its way to executors that don't have it."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Sends the package's modules to all executors, once a session. Tasks in the driver's process import them from where
    they lie."""
    sc = spark.sparkContext
    if re.fullmatch(r"local(\[.*\])?", sc.master):
        sc.environment.setdefault("PYTHONPATH", str(PACKAGE.parent))
    elif not any(Path(p).name == f"{PACKAGE.name}.zip" for p in sc.listFiles):
        made = Path(tempfile.mkdtemp()) / f"{PACKAGE.name}.zip"
        with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(PACKAGE.rglob("*.py")):
                z.write(f, f.relative_to(PACKAGE.parent))
        sc.addPyFile(str(made))
