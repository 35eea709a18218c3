"""Sends the package to the executors, which share no local folder with the driver."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

_MARK = "_tarn_shipped"


def ship(spark: SparkSession) -> None:
    """Adds this package to the Python path of all workers, once a context."""
    sc = spark.sparkContext
    if getattr(sc, _MARK, False):
        return
    home = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tarn-")) / "tarn.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(home.rglob("*.py")):
            archive.write(path, path.relative_to(home.parent))
    sc.addPyFile(str(target))
    setattr(sc, _MARK, True)


def shipped(query: Callable) -> Callable:
    """A query that sees to it that the package is on the executors."""

    @functools.wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run
