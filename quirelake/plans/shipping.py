"""Making the package importable by the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the workers, once for each application.

    Nothing is sent where PYTHONPATH already leads the workers to it.
    """
    sc = spark.sparkContext
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT in known or sc.applicationId in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="quirelake-source-")) / "quirelake.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted((_ROOT / "quirelake").rglob("*.py")):
            out.write(path, path.relative_to(_ROOT))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)
