"""Making the package known to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once an application, unless PYTHONPATH already has it there."""
    package = Path(__file__).resolve().parent
    context = spark.sparkContext
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if context.applicationId in _shipped or package.parent in known:
        return
    target = Path(tempfile.mkdtemp(prefix="quillspark-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted([*package.rglob("*.py"), *package.rglob("*.tsv")]):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
