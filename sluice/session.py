"""The package on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's sources to the executors, once for each application: as with --py-files, for sessions that
    were started without it. Spark serves the file itself; no folder is shared."""
    context = spark.sparkContext
    if context.applicationId not in _sent:
        root = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="spark-sluice-")) / "sluice_sources.zip"
        with zipfile.ZipFile(path, "w") as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, source.relative_to(root.parent))
        context.addPyFile(str(path))
        _sent.add(context.applicationId)
    return spark
