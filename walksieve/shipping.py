"""Sends this package's source to the executors, so that a session may start in any folder."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "walksieve_source.zip"  # read by the driver's own file server only
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SENT.add(app)


def shipped(run):
    """The query with its package sent along first."""
    @functools.wraps(run)
    def wrapped(spark, *args):
        ship(spark)
        return run(spark, *args)
    return wrapped
