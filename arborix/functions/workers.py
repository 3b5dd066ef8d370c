"""The package for Python workers, as the driver alone may have it on its path, and their memory."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def with_package(spark: SparkSession) -> None:
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="arborix-")) / "arborix_core.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))


def give_back() -> None:
    """Hands freed memory back to the system: workers outlive their tasks, and the C library keeps what they free."""
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
