"""Making this package importable in Python workers."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Texts have no bound, so batches to Python workers are cut by bytes, well below Spark's own limit.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, for clusters whose workers do not have it on their path.

    Arrow batches hold at most BATCH_BYTES from here on, or what the session allows if that is less.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(limit).rstrip("b"))
    spark.conf.set(limit, str(min(now, BATCH_BYTES) if now > 0 else BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    base = Path(tempfile.mkdtemp(prefix="sonde-ship-"))
    shutil.copytree(package, base / "src" / package.name, ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(str(base / package.name), "zip", base / "src"))
    _shipped.add(app)
