"""Makes this package importable on the executors of a session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once: executors fetch it from the driver.

    Batches for Python workers are set to fewer rows, unless the session has its own size:
    rows with texts are large, and a batch is held by the JVM and by the worker.
    """
    context = spark.sparkContext
    if spark.conf.get(_BATCH) == "10000":  # the default
        spark.conf.set(_BATCH, "2000")
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="prismgrid-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, str(path.relative_to(root.parent)))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def shipped(query):
    """The query, with the package shipped before it runs."""

    def run(spark: SparkSession, sf_dir: str):
        ship(spark)
        return query(spark, sf_dir)

    run.__name__, run.__doc__ = getattr(query, "__name__", "query"), query.__doc__
    return run
