"""Hand this package to the executors, where functions that run in tasks look it up."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Send the package's source once per application; the cluster copies it to each executor."""
    context = spark.sparkContext
    if getattr(context, "_daybook_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="daybook-code-")) / "daybook_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(PACKAGE.rglob("*.py")):
            out.write(file, file.relative_to(PACKAGE.parent))
    context.addPyFile(str(archive))
    context._daybook_shipped = True
